"""Personal data: plain patterns, and contextual extraction bootstrapped from what they find.

Base spans come from four patterns with checks. Each is a seed: the words around it make
lexical patterns (the two words before; the word before and the word after). Tokens of
letters and digits in long random succession are seeds of a fifth kind, secrets: they are
no finding by themselves, but what they have in common around them is a pattern. All
identifier-like tokens of the table are candidates with the same kind of contexts. On the
graph of patterns and values, rounds of scoring alternate: a pattern's confidence is the
share of known ones among its distinct values, if it has enough of them; a candidate of a
fitting shape in a confident pattern becomes known and supports other patterns, seeded or
not. Rounds end when nothing more becomes known. What confident patterns hold is returned
beside the base spans, as of the pattern's kind.

DataFrame operations throughout. The patterns are written so that their matching is linear
in the text: runs are possessive and start where a run of their characters starts.

Defined results: a null or empty text has no spans. Repeated rows count once as values and
each get their spans. Null doc_ids are rows like others. An empty table gives no rows.
Positions are code points, ends exclusive. Patterns never span lines.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import discard, stage

KINDS = ("email", "ip", "card", "phone")
#: What contexts alone can find, beside more of the base kinds.
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
#: Known values that a pattern needs, and their share among its values.
SUPPORT = 3
CONFIDENCE = 0.75

# Equal to the contract's patterns in what they match: a class's run can't be entered later
# than its start (or the end of the match before), as every later start fails or is reached first.
_WORD = "A-Za-z0-9._%+-"
_PATTERN = {
    "email": rf"(?:\G|(?<![{_WORD}]))[{_WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A quick look for what a match must hold.
_HOLDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_TOKEN = "\\s,;:\"'()<>"
_CANDIDATE = rf"(?<![^{_TOKEN}])[^{_TOKEN}]*[0-9@][^{_TOKEN}]*+"
_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches whose places are added up together; an array that grows by one element at a time costs its length each time.
CHUNK = 256


def _chunks(a: Column) -> Column:
    return F.transform(F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a, i + 1, CHUNK))


def matches(text: str, pattern: str, kind: int) -> Column:
    """All matches in a column with their places: what lies between them gives the offsets."""
    p = _literal(pattern)
    found = F.expr(f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, value) -> struct(length(gap) as gap, value))")

    def within(chunk: Column, at: Column) -> Column:
        def step(a: Column, m: Column) -> Column:
            start = a["at"] + m["gap"]
            own = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m["value"])).alias("end"), m["value"].alias("value"))
            return F.struct((start + F.coalesce(F.length(m["value"]), F.lit(0))).alias("at"), F.when(m["value"].isNull(), a["found"]).otherwise(F.concat(a["found"], F.array(own))).alias("found"))

        return F.aggregate(chunk, F.struct(at.alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("found")), step, lambda a: a["found"])

    def spread(parts: Column) -> Column:
        sizes = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda n, m: n + m["gap"] + F.coalesce(F.length(m["value"]), F.lit(0))))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), within))

    return let(_chunks(found), spread)


def base_spans(text: str) -> Column:
    """The valid matches of all four patterns in a column, by start and then kind."""
    nothing = F.expr(f"cast(array() as array<{_SPAN}>)")
    each = []
    for i, kind in enumerate(KINDS):
        found = F.when(_HOLDS[kind](F.col(text)), matches(text, _PATTERN[kind], i)).otherwise(nothing)
        each.append(found if kind == "email" else F.filter(found, partial(_valid, kind)))
    return _ordered(F.concat(*each))


def _valid(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ip":
        def small(p: Column) -> Column:
            plain = F.regexp_replace(p, "^0+", "")
            return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(s["value"], r"\."), small)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))


_SIGNS = ".!?*#$%&|=[]{}"


def _candidates(text: str) -> Column:
    """Identifier-like tokens: an @, four digits at least, or eight letters and digits; without signs around them."""
    nothing = F.expr(f"cast(array() as array<{_SPAN}>)")
    found = F.when(F.col(text).rlike("[0-9@]"), matches(text, _CANDIDATE, -1)).otherwise(nothing)

    def trim(s: Column) -> Column:
        value = F.ltrim(s["value"], F.lit(_SIGNS))
        left = F.length(s["value"]) - F.length(value)
        value = F.rtrim(value, F.lit(_SIGNS))
        return F.struct((s["start"] + left).alias("start"), F.lit(-1).alias("kind"), (s["start"] + left + F.length(value)).alias("end"), value.alias("value"))

    def identifies(s: Column) -> Column:
        v = s["value"]
        return F.contains(v, F.lit("@")) | (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 4) | (v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.length(v) >= 8))

    return F.filter(F.transform(found, trim), identifies)


def _plain(context: Column) -> Column:
    """A context without case, and with its digits equal and its quotes and brackets blank."""
    return F.translate(F.lower(context), "0123456789\"'`()<>,;", "0000000000")


def _with_contexts(text: str, spans: Column) -> Column:
    def words(s: Column) -> Column:
        lo = F.greatest(s["start"] - 48, F.lit(0))
        before = _plain(F.substring(F.col(text), lo + 1, s["start"] - lo))
        after = _plain(F.substring(F.col(text), s["end"] + 1, F.lit(24)))
        two, one, right = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1), F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(after, r"^\s*(\S+)", 1)
        patterns = F.array(F.when(two != "", F.concat(F.lit("L "), two)), F.when((one != "") & (right != ""), F.concat(F.lit("B "), one, F.lit(" _ "), right)))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))

    return F.transform(spans, words)


def _fits(kind: Column, value: Column) -> Column:
    """Whether a candidate has the shape of a kind."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    plain = value.rlike(r"^[0-9().+-]+$")
    return (
        F.when(kind == 0, value.rlike(r"^[^@]+@[^@]+$"))
        .when(kind == 1, value.rlike(r"^[0-9]+(\.[0-9]+){3}$"))
        .when(kind == 2, plain & digits.between(12, 19))
        .when(kind == 3, plain & digits.between(7, 15))
        .otherwise(value.rlike(r"^[A-Za-z0-9+/_=.~-]{8,}$") & value.rlike("[A-Za-z]") & value.rlike("[0-9]"))
    )


def _is_seed(value: Column) -> Column:
    """Whether a candidate looks random: 20 letters and digits or more that alternate four times at least."""
    return value.rlike(r"^[A-Za-z0-9+/_=-]{20,}+$") & value.rlike(r"^(?:[^0-9]*+[0-9]++[^0-9A-Za-z]*+[A-Za-z]){4}")


def _meets(parts: Column, c: Column) -> Column:
    """Whether a candidate overlaps one of the spans, which come in order and in parts; only parts around it are looked through."""
    def near(part: Column) -> Column:
        return (F.element_at(part, 1)["start"] < c["end"]) & (c["start"] < F.array_max(F.transform(part, lambda s: s["end"])))

    return F.exists(parts, lambda part: F.when(near(part), F.exists(part, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))).otherwise(False))


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """rid, doc_id, kept (a struct of the kept columns), base (spans with contexts) and free (candidates beside them with contexts)."""
    kept = F.struct(*keep) if keep else F.lit(None)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), kept.alias("kept"))
    rows = rows.select("*", base_spans("text").alias("_base"))
    free = let(_chunks(F.col("_base")), lambda parts: F.filter(_candidates("text"), lambda c: ~_meets(parts, c)))
    return rows.select("rid", "doc_id", "kept", _with_contexts("text", F.col("_base")).alias("base"), _with_contexts("text", free).alias("free"))


def discovered(scanned: DataFrame) -> DataFrame:
    """rid and span of the candidates that confident patterns of a kind hold."""
    base = scanned.select("rid", F.explode("base").alias("s")).select("rid", "s.*")
    free = scanned.select("rid", F.explode("free").alias("s")).select("rid", "s.*")
    edges = base.unionByName(free).select(F.explode("patterns").alias("pattern"), "value", "kind").distinct()
    edges = stage(edges)
    seeds = edges.where((F.col("kind") < 0) & _is_seed(F.col("value"))).select("value", F.lit(SECRET).alias("kind"))
    known = stage(edges.where("kind >= 0").select("value", "kind").unionByName(seeds).distinct())
    values = edges.select("pattern", "value").distinct()
    # a pattern of fewer values than SUPPORT can't become confident, whatever becomes known
    totals = stage(values.groupBy("pattern").agg(F.count("*").alias("all")).where(F.col("all") >= SUPPORT))
    values = stage(values.join(totals, "pattern", "left_semi"))
    count = known.count()
    while True:
        supported = values.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
        confident = stage(supported.join(totals, "pattern").where(F.col("n") >= CONFIDENCE * F.col("all")).select("pattern", "kind"))
        grown = values.join(confident, "pattern").where(_fits(F.col("kind"), F.col("value"))).select("value", "kind")
        grown = stage(known.unionByName(grown).distinct())
        discard(known)
        known, before, count = grown, count, grown.count()
        if count == before:
            break
    spans = free.select("rid", "start", "end", "value", F.explode("patterns").alias("pattern")).join(confident, "pattern")
    return spans.where(_fits(F.col("kind"), F.col("value"))).groupBy("rid", "start").agg(F.min(F.struct("kind", "end", "value")).alias("s")).select("rid", "start", "s.*")


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, kept columns, base and spans: arrays of (start, kind, end, value), spans with the discovered ones."""
    if clash := {"doc_id", "base", "spans"} & set(keep):
        raise ValueError(f"columns that the result has itself: {sorted(clash)}")
    scanned = stage(scan(docs, *keep))
    more = discovered(scanned).groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end", "value")).alias("more"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    joined = scanned.withColumn("base", plain).join(more, "rid", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return joined.select("doc_id", *[F.col("kept")[c].alias(c) for c in keep], "base", spans.alias("spans"))


def told(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; where spans overlap, the first is replaced to the end of all."""
    columns = docs.columns
    found = find(docs.select("doc_id", "text", F.struct(*columns).alias("_row")), "_row")
    names = F.array(*map(F.lit, [f"[{k.upper()}]" for k in NAMES]))
    text = F.coalesce(F.col("_row")["text"], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        before = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], before, names[s["kind"]])).otherwise(a["out"]).alias("out"))

    masked = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    masked = F.when(F.size("spans") == 0, F.col("_row")["text"]).otherwise(masked)
    return found.select(*[masked.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns])
