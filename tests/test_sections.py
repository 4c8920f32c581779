"""Repeated word sections against the definition on all windows, and on long texts."""

from difflib import SequenceMatcher

import numpy as np
import pytest

from chartspark.operators import sections as S


def brute(tokens, low=8, high=100):
    """Greedy choice over all pairs of windows within the rules."""
    n, found = len(tokens), []
    for la in range(low, min(high, n // 2) + 1):
        for a in range(n - la + 1):
            for b in range(a + la, n - low + 1):
                for lb in range(max(low, int(la * 0.8)), min(high, int(la * 1.2), n - b) + 1):
                    s = SequenceMatcher(None, tokens[a : a + la], tokens[b : b + lb], autojunk=False).ratio()
                    if s >= 0.8:
                        found.append((min(la, lb), s, a, a + la, b, b + lb))
    found.sort(key=lambda c: c[:2], reverse=True)
    used, out = set(), []
    for _, s, a, ae, b, be in found:
        words = {*range(a, ae), *range(b, be)}
        if not words & used:
            used |= words
            out.append((a, ae, b, be, s))
    return out


def words(rng, n, size=10**9):
    return [f"w{i}" for i in rng.integers(0, size, n)]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>")
    out = {i: [] for i in range(len(texts))}
    for r in S.repeated_sections(df, "id", "tokens").collect():
        out[r.id].append((r.a, r.a_end, r.b, r.b_end, r.similarity))
    return out


def test_exact_repeats_as_by_all_windows(spark):
    rng = np.random.default_rng(0)
    block, other = words(rng, 11), words(rng, 9)
    fill = lambda n: words(rng, n)
    texts = [
        block + fill(3) + block, fill(2) + block + block + fill(2), fill(30), block[:7] + fill(4) + block[:7], block + other + fill(3) + other + block,
        other[:8] + other[:8], fill(20) + other + fill(1) + other,
    ]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert sorted(p[:4] for p in got[i]) == sorted(p[:4] for p in brute(text)), i
    assert len(got[0]) == 1 and got[2] == [] and len(got[3]) == 1


def test_changed_words_are_bridged_and_pairs_keep_the_rules(spark):
    rng = np.random.default_rng(1)
    texts = []
    for change in ("swap", "drop", "add", "two"):
        block = words(rng, 20)
        copy = list(block)
        if change in ("swap", "two"):
            copy[9] = "x"
        if change == "two":
            copy[15] = "y"
        if change == "drop":
            del copy[9]
        if change == "add":
            copy.insert(9, "x")
        texts.append(words(rng, 5) + block + words(rng, 6) + copy + words(rng, 5))
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert len(got[i]) == 1, i
        a, a_end, b, b_end, s = got[i][0]
        assert a <= 5 and a_end >= 25 and b <= 31 and b_end >= 50 and abs((a_end - a) - (b_end - b)) <= 1
        assert 0.8 <= s == pytest.approx(SequenceMatcher(None, text[a:a_end], text[b:b_end], autojunk=False).ratio())


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_against_all_windows(spark, seed):
    """Wherever all windows find a pair, seeds find one, and never where there is none; every pair keeps the rules."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(6):
        block = words(rng, int(rng.integers(8, 13)))
        copy = [w if rng.random() > 0.06 else "z" for w in block]
        texts.append(words(rng, int(rng.integers(0, 4))) + block + words(rng, int(rng.integers(0, 4))) + (copy if rng.random() > 0.3 else words(rng, 9)))
    got = found(spark, texts)
    for i, text in enumerate(texts):
        wanted, used = brute(text), set()
        for a, a_end, b, b_end, s in got[i]:
            mine = [*range(a, a_end), *range(b, b_end)]
            assert a_end <= b and 8 <= a_end - a <= 100 and 8 <= b_end - b <= 100 and s >= 0.8 and not used & set(mine)
            assert int((a_end - a) * 0.8) <= b_end - b <= int((a_end - a) * 1.2)
            used |= set(mine)
        assert len(got[i]) == len(wanted)


def test_periods_hot_words_and_long_texts(spark):
    rng = np.random.default_rng(4)
    period = words(rng, 10)
    chorus = words(rng, 40)
    long_text = [w for i in range(1000) for w in [*chorus, *words(rng, 60)]]
    got = found(spark, [["la"] * 400, period * 20, ["la"] * 100_000, long_text, words(rng, 100_000, 50)])
    assert got[0] and all(p[1] - p[0] >= 96 for p in got[0][:2]) and sum(p[1] - p[0] for p in got[0]) >= 190
    assert sorted(p[:4] for p in got[1]) == [(0, 100, 100, 200)]
    assert len(got[2]) >= 500
    assert len(got[3]) == 500 and {p[1] - p[0] for p in got[3]} == {50} and len(long_text) == 100_000


def test_counts_and_states(spark):
    rng = np.random.default_rng(5)
    block = words(rng, 12)
    rows = [(0, [], 1), (1, None, 1), (2, words(rng, 15), 1), (3, words(rng, 16), 1), (4, block * 2, 1), (None, block * 2, 1)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, a int")
    out = {r.id: (r.sections, r.section_words, r.status) for r in S.section_repetition(df.where("id IS NOT NULL"), "id", "tokens").collect()}
    assert out == {0: (None, None, "empty_lyrics"), 1: (None, None, "empty_lyrics"), 2: (None, None, "insufficient_lyrics"), 3: (0, 0, "success"), 4: (1, 24, "success")}
    assert S.section_repetition(df.limit(0), "id", "tokens").collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([("[Chorus: A]\nIt's ÉTÉ,  été -- 12_3! x", ), ("",), (None,)], "t string")
    assert [r.t for r in df.select(S.section_tokens("t").alias("t")).collect()] == [["it", "s", "été", "été", "12_3", "x"], [], None]


def runs_by_definition(tokens, k=3, low=8):
    """Links of each run of three words to its next occurrence a block further on, put together where places follow each other."""
    later, links = {}, {}
    for i in range(len(tokens) - k, -1, -1):
        places = later.setdefault(tuple(tokens[i : i + k]), [])
        nearest = next((p for p in reversed(places) if p - i >= low), None)  # the nearest place comes last
        if nearest is not None:
            links.setdefault(nearest - i, set()).add(i)
        places.append(i)
    out = []
    for offset, places in links.items():
        for start in sorted(p for p in places if p - 1 not in places):
            end = next(p for p in range(start, len(tokens)) if p not in places)
            out.append((len(tokens), offset, start, end - start + k - 1))
    return sorted(out) if len(tokens) >= 2 * low else []


def test_runs_are_found_inside_a_text_and_no_word_is_shuffled(spark):
    rng = np.random.default_rng(6)
    texts = [words(rng, int(rng.integers(0, 90)), size) for size in (1, 2, 3, 5, 10**9) for _ in range(12)]
    chorus = words(rng, 20)
    texts += [chorus, chorus, [], chorus[:15], ["", *chorus, "", *chorus], words(rng, 150_000) + chorus * 2, words(rng, 3_000, 40), chorus * 2]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, tokens array<string>")
    runs = S.section_runs(df.coalesce(1), "id", "tokens")
    got = {i: [] for i in range(-1, len(texts))}
    for r in runs.collect():
        got[r.id].append(tuple(r)[1:])
    assert got.pop(-1) == []
    for i, text in enumerate(texts):
        assert sorted(got[i]) == runs_by_definition(text), i
    assert "Exchange hashpartitioning" not in S.section_runs(df, "id", "tokens")._jdf.queryExecution().executedPlan().toString()


def test_words_are_cut_and_compared_once(spark):
    rng = np.random.default_rng(7)
    block = words(rng, 20)
    df = spark.createDataFrame([(1, " ".join([*block, "a", "b", *block[:9], "x", *block[10:]]))], "id int, t string").select("id", S.section_tokens("t").alias("tokens"))
    out = S.section_repetition(df, "id", "tokens")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(1, 1, 42, "success")]
    assert "regexp_replace" not in plan and sum("ArrowEvalPython [sequence_similarity" in line for line in plan.split("\n")) == 1
