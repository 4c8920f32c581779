"""Personal data: fixed expressions give the seeds, their contexts become patterns, and good patterns find further mentions.

Base kinds are found by expression and check. Looser shapes give candidates: runs of digits without the country sign or the
right check digit, addresses with the signs spelled out, addresses of the newer net. Each mention stands in up to three
lexical patterns: the word before, the two words before, the word after. A graph joins patterns and identifiers (the digits
or letters of a mention, without separators). In each round a pattern's score is the mean confidence of the identifiers of
one kind that it meets, and an identifier's confidence is that at least one of its good patterns is right. Seeds have
confidence 1 throughout. Rounds go on until one adds nothing. A candidate counts when its identifier is confident and one of its own patterns is good, or when
it repeats a seed.

Everything is DataFrame code. Only mentions are shuffled, never texts, and all group sums are combined before the shuffle.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale

KINDS = ("email", "ip", "card", "phone")
MOST_ROUNDS = 1000  # a graph that still grows then is an error, not a result
SUPPORT = 3  # confident identifiers that a good pattern has met
PATTERN_SCORE = 0.8
CONFIDENCE = 0.9

# Expressions. Possessive repeats and the look behind keep each scan linear in the text and its matches the same.
_PART = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Shape:
    kinds: tuple[str, ...]
    hint: str  # a quick test of the text
    pattern: str


BASE = (
    Shape(("email",), "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Shape(("ip",), r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Shape(("card",), "[0-9][ -]?[0-9]", "[0-9](?:[ -]?[0-9])++"),
    Shape(("phone",), r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
)
LOOSE = (
    Shape(("email",), r"@|[\[(]at[\])]", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+"),
    Shape(("ip",), "[0-9a-f]:", "(?<![0-9A-Za-z:])[0-9a-f]{1,4}+(?::[0-9a-f]{0,4}+){3,7}+(?![0-9A-Za-z:])"),
    Shape(("phone", "card"), "[0-9][ ().-]{0,2}[0-9]", "(?<![0-9A-Za-z])[0-9](?:[ ().-]{0,2}+[0-9])++(?![0-9A-Za-z])"),
)

# The last two words of what stands before a mention, and the rest of its own word with the next one of what stands after.
_TWO_BEFORE = r"(?<!\S)(?:\S++\s++)?\S++\s*+$"
_ONE_AFTER = r"^\S*+\s++\S++"

_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]++", "")


def luhn(digits: Column) -> Column:
    """Check digit of up to 19 digits."""
    d = F.lpad(digits, 19, "0")
    at = lambda i: F.substring(d, i, 1).cast("int")
    total = F.lit(0)
    for i in range(1, 20):
        total = total + (at(i) if i % 2 else at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^0*{_PART}\.0*{_PART}\.0*{_PART}\.0*{_PART}$")
    if kind == "card":
        return size.between(16, 19) & luhn(_digits(value))
    if kind == "phone":
        return size.between(8, 15)
    return F.lit(True)


def matches(text: Column, shape: Shape) -> Column:
    """array<struct<gap, size, value, before, after>> of the leftmost matches that don't overlap.

    The pieces between the matches give the places, gap being the length of the one before, and the neighbouring words.
    """
    there = text.rlike(shape.hint) if shape.hint != "@" else F.contains(text, F.lit("@"))
    found = F.when(there, F.regexp_extract_all(text, F.lit(shape.pattern), F.lit(0)))
    between = F.when(there, F.split(text, shape.pattern, -1))
    size = F.size(found)
    sides = F.zip_with(F.slice(between, 1, size), F.slice(between, 2, size), lambda gap, rest: F.struct(
        F.length(gap).cast("long").alias("gap"), F.regexp_extract(gap, _TWO_BEFORE, 0).alias("before"), F.regexp_extract(rest, _ONE_AFTER, 0).alias("after"),
    ))
    return F.when(size > 0, F.zip_with(found, sides, lambda m, s: F.struct(
        s["gap"].alias("gap"), F.length(m).cast("long").alias("size"), m.alias("value"), s["before"].alias("before"), s["after"].alias("after"),
    )))


def _identifier(kind: Column, value: Column) -> Column:
    """What a mention names, whatever its separators; hashed, so that the graph holds no personal data."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), r" ?[\[(]at[\])] ?", "@"), r" ?[\[(]dot[\])] ?", ".")
    return F.md5(F.when(kind.isin("card", "phone"), _digits(value)).otherwise(plain).cast("binary"))


def _word(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(value, r"[0-9]++", "#"), r"^[^\p{L}#]+|[^\p{L}#]+$", ""))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns around a mention."""
    near, far = (_word(F.regexp_extract(before, r"^(?:(\S++)\s++)?(\S++)\s*+$", i)) for i in (2, 1))
    follow = _word(F.regexp_extract(after, r"^\S*+\s++(\S++)", 1))
    three = F.array(
        F.when(near != "", F.concat(F.lit("before "), near)), F.when((near != "") & (far != ""), F.concat(F.lit("before "), far, F.lit(" "), near)),
        F.when(follow != "", F.concat(F.lit("after "), follow)),
    )
    return F.array_compact(three)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, _key (a hash of id and text), _found with the matches of all shapes, null without any."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    each = [matches(F.col("body"), s).alias(f"s{i}") for i, s in enumerate(BASE + LOOSE)]
    found = rows.select("doc_id", F.xxhash64("doc_id", "body").alias("_key"), *each)
    names = [f"s{i}" for i in range(len(each))]
    return found.select("doc_id", "_key", F.when(F.coalesce(*names).isNotNull(), F.struct(*names)).alias("_found"))


def mentions(found: DataFrame) -> DataFrame:
    """One row per mention and possible kind: doc_id, _key, kind, seed, start, end, identifier, patterns.

    Places are running sums over a text's matches of one shape. Loose matches that overlap a seed are left out. Only rows of
    one text are ordered together.
    """
    texts = found.where("_found IS NOT NULL").dropDuplicates(["doc_id", "_key"])
    rows = None
    for i in range(len(BASE + LOOSE)):
        part = texts.select("doc_id", "_key", F.lit(i).alias("shape"), F.posexplode(f"_found.s{i}").alias("at", "m"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.select("doc_id", "_key", "shape", "at", "m.*")
    inside = W.partitionBy("doc_id", "_key", "shape").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(inside)).withColumn("start", F.col("end") - F.col("size"))
    holds = F.lit(False)
    for i, shape in enumerate(BASE):
        holds = F.when(F.col("shape") == i, _holds(shape.kinds[0], F.col("value"))).otherwise(holds)
    rows = rows.withColumn("seed", holds).where(F.col("seed") | (F.col("shape") >= len(BASE)))
    text = W.partitionBy("doc_id", "_key")
    left = F.max(F.when(F.col("seed"), F.col("end"))).over(text.orderBy(F.col("start"), F.col("seed").desc()).rowsBetween(W.unboundedPreceding, -1))
    right = F.min(F.when(F.col("seed"), F.col("start"))).over(text.orderBy(F.col("start").desc(), F.col("seed").desc()).rowsBetween(W.unboundedPreceding, -1))
    clear = (F.coalesce(left, F.lit(0)) <= F.col("start")) & (F.coalesce(right, F.col("end")) >= F.col("end"))
    rows = rows.withColumn("clear", clear).where("seed OR clear")
    kinds = F.array(*[F.array(*map(F.lit, s.kinds)) for s in BASE + LOOSE])
    rows = rows.withColumn("kind", F.explode(F.element_at(kinds, F.col("shape") + 1)))
    size = F.length(_digits(F.col("value")))
    fits = F.when(F.col("seed"), True).when(F.col("kind") == "phone", size.between(8, 15)).when(F.col("kind") == "card", size.between(12, 19)).otherwise(True)
    rows = rows.where(fits)
    return rows.select("doc_id", "_key", "kind", "seed", "start", "end", _identifier(F.col("kind"), F.col("value")).alias("identifier"), _patterns(F.col("before"), F.col("after")).alias("patterns"))


def bootstrap(graph: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Good patterns (pattern, kind, score) and confident identifiers (identifier, kind, confidence) of the graph.

    graph: kind, identifier, seed, pattern; a row may repeat. Goes on until a round adds nothing, which comes at last because
    confidences only rise; a given number of rounds ends it earlier. A graph that grows for MOST_ROUNDS rounds raises.
    """
    edges = graph.groupBy("kind", "identifier", "pattern").agg(F.max("seed").alias("seed"))
    edges = scale.cut_lineage(edges)
    seeds = edges.groupBy("kind", "identifier").agg(F.max("seed").alias("seed"))
    seeds = scale.cut_lineage(seeds.where("seed").select("kind", "identifier", F.lit(1.0).alias("confidence")))
    known, count = seeds, -1
    for number in itertools.count(1):
        judged = edges.join(known, ["kind", "identifier"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        scored = judged.groupBy("kind", "pattern").agg(F.avg("confidence").alias("score"), F.count_if(F.col("confidence") >= CONFIDENCE).alias("met"))
        good = scale.cut_lineage(scored.where((F.col("met") >= SUPPORT) & (F.col("score") >= PATTERN_SCORE)).select("kind", "pattern", "score"))
        doubt = F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))
        found = edges.join(good, ["kind", "pattern"]).groupBy("kind", "identifier").agg((1 - doubt).alias("confidence"))
        new = found.where(F.col("confidence") >= CONFIDENCE).join(seeds.select("kind", "identifier"), ["kind", "identifier"], "left_anti")
        known = scale.cut_lineage(seeds.unionByName(new))
        now = known.count()
        if now == count or number == rounds:
            break
        if number == MOST_ROUNDS:
            raise RuntimeError(f"patterns and identifiers still grow after {MOST_ROUNDS} rounds")
        count = now
    return good, known


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per input row: doc_id, base and spans as array<struct<kind, start, end>>, by kind as listed, then start.

    spans holds the base ones and what the patterns add. Null text counts as empty and gives none. Rows that repeat an id and
    a text get the same spans. Without seeds nothing is added. Other columns are ignored.
    """
    found = scale.cut_lineage(keyed(docs, doc_id, text))
    each = scale.cut_lineage(mentions(found))
    graph = each.select("kind", "identifier", "seed", F.explode("patterns").alias("pattern"))
    good, known = bootstrap(graph, rounds)
    open_ones = each.where("NOT seed").select("doc_id", "_key", "start", "end", "kind", "identifier", "patterns")
    # a repeated seed needs no pattern of its own
    seeds = each.where("seed").select("kind", "identifier").distinct()
    repeats = open_ones.join(seeds, ["kind", "identifier"], "left_semi").select("doc_id", "_key", "kind", "start", "end", F.lit(1.0).alias("confidence"))
    led = open_ones.select("*", F.explode("patterns").alias("pattern")).join(good, ["kind", "pattern"]).join(known, ["kind", "identifier"])
    led = led.select("doc_id", "_key", "kind", "start", "end", "confidence")
    best = repeats.unionByName(led).groupBy("doc_id", "_key", "start", "end").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    every = each.where("seed").select("doc_id", "_key", "kind", "start", "end", "seed").unionByName(best.withColumn("seed", F.lit(False)))
    spans = every.groupBy("doc_id", "_key").agg(F.collect_list(F.struct(_number(F.col("kind")).alias("number"), "start", "end", "kind", "seed")).alias("all"))
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_k"), F.sort_array("all").alias("all"))
    joined = found.select("doc_id", "_key").join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_k")), "left")
    plain = lambda c: F.coalesce(F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast(_SPANS))
    return joined.select("doc_id", plain(F.filter("all", lambda s: s["seed"])).alias("base"), plain(F.col("all")).alias("spans"))


def _number(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)
