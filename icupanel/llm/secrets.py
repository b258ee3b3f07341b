"""Secret scans: sure findings by pattern, weak ones by linking the parts of a credential.

Assignments to secret names, access identifiers and long hexadecimal runs are
reported as they stand.  A login name, a mixed token or an endpoint says little
alone; it is a part of a credential, reported only where the parts that complete
it lie near in the same scope, a stretch of text between blank lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icupanel.llm.common import durable


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
#: Pattern and number of the group that is a finding's body, by kind; base kinds first, in the order of reports.
PATTERNS = {
    "assign": (f"({either_case('password|passwd|secret|token|api_?key')}){_SIGN}([A-Za-z0-9+/_.=-]+)", 2),
    "access": ("AKIA[A-Z0-9]{16,}", 0),
    "hex": ("[0-9a-f]{24,}", 0),
    "identifier": (f"({either_case('user_?name|login|client_?id|account_?id|access_?key_?id')}){_SIGN}([A-Za-z0-9+/_.=@-]+)", 2),
    "secret": ("[A-Za-z0-9+/_-]{20,}", 0),
    "endpoint": ("https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0),
}
KINDS = tuple(PATTERNS)
BASE = KINDS[:3]
#: A blank line, which parts scopes.
BREAK = r"\n[ \t\r]*\n"


def _mixed(body: Column) -> Column:
    return reduce(lambda a, b: a & b, [body.rlike(f"[{c}]") for c in ("0-9", "a-z", "A-Z")])


#: Of a kind's matches only those whose body holds this are findings; the others still use up their text.
KEPT: dict[str, Callable[[Column], Column]] = {"assign": lambda body: F.length(body) >= 6, "identifier": lambda body: F.length(body) >= 3, "secret": _mixed}


def _matches(text: Column, number: int, pattern: str, body: int, kept: Callable[[Column], Column]) -> Column:
    """(kind, n, skip, size, kept) of each match: its number, the characters between it and the match before, its own, and whether it is a finding."""
    found = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(found(0).alias("whole"), found(body).alias("body"), F.split(text, pattern, -1).alias("gap"))
    each = F.transform(zipped, lambda m, n: F.struct(F.lit(number).alias("kind"), n.alias("n"), F.length(m["gap"]).alias("skip"), F.length(m["whole"]).alias("size"), kept(m["body"]).alias("kept")))
    none = F.array().cast("array<struct<kind:int,n:int,skip:int,size:int,kept:boolean>>")
    return F.when(text.rlike(pattern), F.filter(each, lambda m: m["size"].isNotNull())).otherwise(none)


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, parts) for every row of `docs`, in one scan: the matches of all kinds and, as the last kind, of blank lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    always = lambda _: F.lit(True)
    found = [_matches(body, k, pattern, group, KEPT.get(kind, always)) for k, (kind, (pattern, group)) in enumerate(PATTERNS.items())]
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.concat(*found, _matches(body, len(KINDS), BREAK, 0, always)).alias("parts"))


def _is(kinds: Sequence[str]) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def linked(found: DataFrame, reach: int) -> DataFrame:
    """(row, kind, start, stop) of all base findings, and of the weak ones that are completed.

    `found` has (row, parts).  Within a scope each part needs only the nearest
    ones of the complementary kinds on both sides, running extremes in the order
    of the text and against it, so no pairs are made.
    """
    each = found.select("row", F.explode("parts").alias("p")).select("row", "p.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("n")
    stop = F.sum(F.col("skip") + F.col("size")).over(upto)
    placed = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where("kept").select("row", "kind", "start", "stop")
    order = ["start", "kind", "stop"]
    scope = F.count_if(F.col("kind") == len(KINDS)).over(Window.partitionBy("row").orderBy(*order))
    scoped = placed.withColumn("scope", scope).where(F.col("kind") < len(KINDS))
    w = Window.partitionBy("row", "scope")
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = w.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    groups = {"own": BASE, "names": ("access", "identifier"), "keys": ("assign", "hex", "secret"), "places": ("endpoint",)}
    sides = scoped.withColumns({f"{g}_before": F.max(F.when(_is(k), F.col("stop"))).over(before) for g, k in groups.items()})
    sides = sides.withColumns({f"{g}_after": F.min(F.when(_is(k), F.col("start"))).over(after) for g, k in groups.items()})
    true = lambda c: F.coalesce(c, F.lit(False))
    near = {g: true(F.col("start") - F.col(f"{g}_before") <= reach) | true(F.col(f"{g}_after") - F.col("stop") <= reach) for g in groups}
    inside = true(F.col("own_before") > F.col("start")) | true(F.col("own_after") < F.col("stop"))
    complete = (
        (_is(["identifier"]) & near["keys"]) | (_is(["secret"]) & (near["names"] | near["places"])) | (_is(["endpoint"]) & near["names"] & near["keys"]))
    return sides.where(_is(BASE) | (complete & ~inside)).select("row", "kind", "start", "stop")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """(doc_id, spans) for every row of `docs`; spans: (start, kind, stop) in characters, by start, then kind, an index of `KINDS`.

    Base findings always come out.  Of the weak ones, none of which may overlap a
    base finding, a login name is completed by an assignment, hexadecimal run or
    mixed token at most `reach` characters away in the same scope; a mixed token
    (digits, small and capital letters, 20 or more) by an access identifier, a
    login name or an endpoint; an endpoint by a name and a secret both.
    Overlapping parts count as near.

    Null and empty texts have no spans.  Repeated rows come out as often as they
    went in, rows of one doc_id each for itself; an empty table gives no rows,
    and other columns are dropped.  Nothing but a document's own findings is
    gathered in a row.
    """
    found = durable(parts(docs, doc_id, text))
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", "stop")))
    per = linked(found.where(F.size("parts") > 0), reach).groupBy(F.col("row").alias("r")).agg(spans.alias("spans"))
    none = F.array().cast(per.schema["spans"].dataType)
    return found.select("row", "doc_id").join(per, F.col("row") == F.col("r"), "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def shown(spans: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
