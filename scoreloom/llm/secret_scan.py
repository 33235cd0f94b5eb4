"""Secret scans with linking of multipart credentials, in DataFrame functions only.

Strong patterns stand by themselves. Weak parts (names of accounts, short or oddly named secrets,
endpoints) are everywhere in clean text; they are reported only where complementary parts lie within
``scope`` code points, between the end of one and the start of the other: an identifier next to a secret, a weak secret next to an identifier or an
endpoint, an endpoint next to both. Linking is an interval join of parts, on the document and a bin
of ``scope`` code points of its start and its end, with neighbouring bins.

Spark gives the texts of matches but not their places; these come from a mark that is put before each
match, and that is then looked for among the text's characters. So the cost of a text is linear in its
length and its matches; a text with matches is held as an array of its characters meanwhile, about 40
bytes a character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cut import cut

#: Fixed patterns: what is matched, and the group whose length counts with its least length.
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}+", 0, 24),
}
#: Further parts of a name, joined by _ . or -; not those that make it the name of something else.
_MORE = r"""(?:[_.-](?i:(?!%s))[A-Za-z0-9]++){0,4}+["']?\x20*[:=]\x20*["']?"""
_TO_IDENTIFIER = _MORE % "pass|pwd|secret|token|auth|cred|private|signature|url|host|server|endpoint"
_TO_SECRET = _MORE % "user|login|account|name|url|host|server|endpoint"
WEAK = {
    "identifier": (r"""(?<![A-Za-z0-9])(?<!(?i:secret)[_.-])((?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?))""" + _TO_IDENTIFIER + r"""([A-Za-z0-9._@-]+)""", 2, 3),
    "weak_secret": (r"""(?<![A-Za-z0-9])((?i:pwd|pass|passphrase|credentials?|auth|bearer|private_?key|signature|password|passwd|secret(?:_?access)?(?:_?key)?))""" + _TO_SECRET + r"""([^\s"']+)""", 2, 4),
    "endpoint": (r"""(?i:\b[a-z][a-z0-9+.]{1,20}://[A-Za-z0-9._~@%:-]+|(?<![A-Za-z0-9])(?:host|server|endpoint|url)(?:[_.-][a-z0-9]++){0,4}+["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})""", 0, 6),
}
#: Strings that look like keys, whatever stands before them; weak secrets if they are as mixed as random ones.
_BARE = r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]{0,63}+[A-Z])(?=[A-Z0-9+/_-]{0,63}+[a-z])[A-Za-z0-9+/_-]{32,64}+(?![A-Za-z0-9+/_-])={0,2}+"
_BITS = 4.0
#: Cheap necessary conditions of the patterns that need a mark.
_NEEDS = {"assign": "[:=]", "identifier": "[:=]", "weak_secret": "[:=]", "endpoint": "[:=]"}
KINDS = (*STRONG, *WEAK)
_MARK = "\u0001"
_ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost matches of a kind that don't overlap, as (start, kind, end) in code points, without those that are too short."""
    return _spans(text, kind, *{**STRONG, **WEAK}[kind])


def bits(value: Column) -> Column:
    """Shannon entropy of the characters, in bits a character."""
    chars = F.split(F.rtrim(value, F.lit("=")), "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda sum, c: sum - share(c) * F.log2(share(c)))


def weak_secrets(text: Column) -> Column:
    """Bare strings of high entropy, as spans of weak secrets."""
    return _spans(text, "weak_secret", _BARE, 0, 32, lambda v: bits(v) >= _BITS, "[A-Za-z0-9+/_-]{32}")


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, fits: Callable[[Column], Column] | None = None, needs: str | None = None) -> Column:
    p = F.lit(pattern)
    own = F.translate(text, _MARK, "\u0002")  # no pattern tells these two apart
    lengths = F.transform(F.regexp_extract_all(own, p, 0), F.length)
    chars = F.split(F.regexp_replace(own, p, F.lit(_MARK + "$0")), "")
    marks = F.filter(F.transform(chars, lambda c, i: F.when(c == _MARK, i)), lambda i: i.isNotNull())
    number = F.lit(KINDS.index(kind))
    spans = F.transform(F.arrays_zip(marks.alias("i"), lengths.alias("n")), lambda x, k: F.struct((x["i"] - k).alias("start"), number.alias("kind"), (x["i"] - k + x["n"]).alias("end")))
    values = F.regexp_extract_all(own, p, group)
    whole = lambda v: (F.length(v) >= least) & fits(v) if fits else F.length(v) >= least
    spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), values.alias("v")), lambda x: whole(x["v"])), lambda x: x["s"])
    there = text.rlike(pattern)
    if needs := needs or _NEEDS.get(kind):
        there = text.rlike(needs) & there
    return F.coalesce(F.when(there, spans), F.array()).cast(_SPAN)


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """Those weak parts that have their complements within scope. parts: h1, h2 (the row), start, kind, end."""
    roles = F.array(*(F.lit(_ROLES[k]) for k in KINDS))
    parts = parts.withColumn("role", F.element_at(roles, F.col("kind") + 1)).withColumn("bins", F.array_distinct(F.array(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    around = F.array_distinct(F.flatten(F.transform("bins", lambda b: F.array(b - 1, b, b + 1))))
    near = parts.select("h1", "h2", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("r2"), F.explode(around).alias("bin"))
    weak = parts.where(F.col("kind") >= len(STRONG)).withColumn("bin", F.explode("bins"))
    # a secret under two patterns is no complement of itself: roles differ, and spans that overlap don't count
    apart = (F.col("s2") >= F.col("end")) | (F.col("e2") <= F.col("start"))
    both = weak.join(near, ["h1", "h2", "bin"]).where((F.greatest("start", "s2") - F.least("end", "e2") <= scope) & (F.col("r2") != F.col("role")) & apart)
    has = both.groupBy("h1", "h2", "start", "kind", "end", "role").agg(F.bool_or(F.col("r2") == "secret").alias("s"), F.bool_or(F.col("r2") == "identifier").alias("i"), F.bool_or(F.col("r2") == "endpoint").alias("e"))
    return has.where("(role = 'identifier' AND s) OR (role = 'secret' AND (i OR e)) OR (role = 'endpoint' AND s AND i)")


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(rank).alias("rank")))


def _overlapped(rank: int) -> Column:
    """Whether a span of that rank overlaps this one: the spans of a row, ordered, that begin before or with it, and those after it. A window holds one row's spans."""
    ordered = Window.partitionBy("h1", "h2").orderBy("start", "rank", "kind", "end")
    own = F.col("rank") == rank
    before = F.max(F.when(own, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(own, F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    return (F.coalesce(before, F.lit(-1)) > F.col("start")) | (F.coalesce(after < F.col("end"), F.lit(False)))


def scan(docs: DataFrame, scope: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked of every row.

    Spans are kind:start:end of whole matches, ordered by start and then by kind; kinds after the first three are linked weak parts. A weak secret that a strong match covers is not reported again. Null texts are empty and have no span. Rows are told apart by hashes of id and text, so rows that repeat an id get their own spans, and repeated rows equal ones.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), content.alias("t"))
    found = base.select("doc_id", F.xxhash64("doc_id", "t").alias("h1"), F.hash("t", "doc_id").alias("h2"), *(spans_of(F.col("t"), k).alias(k) for k in KINDS), weak_secrets(F.col("t")).alias("bare"))
    found = cut(found)
    strong = F.concat(*(F.col(k) for k in STRONG))
    named = F.concat(*(F.col(k) for k in WEAK))
    some = found.where((F.size(named) > 0) | (F.size("bare") > 0))
    ranked = F.concat(*(_ranked(x, rank) for rank, x in enumerate((strong, named, F.col("bare")))))
    parts = some.select("h1", "h2", F.explode(ranked).alias("x")).select("h1", "h2", "x.*").distinct()
    outside = [*(~_overlapped(r) for r in (0, 1))]
    alone = (F.col("rank") == 0) | outside[0] & ((F.col("rank") == 1) | outside[1])
    parts = parts.withColumn("alone", alone).where("alone").select("h1", "h2", "start", "kind", "end").distinct()
    links = linked(parts, scope).groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "kind", "end")).alias("links"))
    out = found.join(links, ["h1", "h2"], "left")
    ordered = F.sort_array(strong)
    every = F.sort_array(F.concat(strong, F.coalesce("links", F.array().cast(_SPAN))))
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in STRONG), F.sha2(joined(ordered), 256).alias("base_sha256"), joined(every).alias("spans"), F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n_linked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
