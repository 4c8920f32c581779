"""Shares of languages that fall on a half of the fourth place round as SQL does."""

import duckdb

from chartspark.functions import text as X

VOTES = [(1262, 338), (1254, 346), (1146, 454), (1138, 462), (1062, 538), (1, 799), (3, 1597), (1, 0)]


def test_shares_at_halves_agree_with_sql(spark):
    lines = [(i, "en" if j == 0 else "fr", n, 0, 0, 0, 0) for i, pair in enumerate(VOTES) for j, n in enumerate(pair) if n]
    # a language's votes are lines of 15 letters at least
    lines = [(i, name, n * 20, ko, ja, zh, total) for i, name, n, ko, ja, zh, total in lines]
    facts = spark.createDataFrame(lines, "k long, line_language string, latin long, ko long, ja long, zh long, script_total long")
    got = {r["k"]: {n: f"{s:.4f}" for n, s in r["shares"].items()} for r in X.vote_language(facts, "k", ["en", "fr"]).collect()}
    con = duckdb.connect()
    for i, (a, b) in enumerate(VOTES):
        exact = {n: con.execute("SELECT printf('%.4f', round_even(?::HUGEINT / ?::HUGEINT, 4))", [v * 20, (a + b) * 20]).fetchone()[0] for n, v in (("en", a), ("fr", b)) if v}
        assert got[i] == exact
