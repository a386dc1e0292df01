"""Personal data: fixed shapes, and boosted trees over loose proposals, in Spark SQL only.

Shapes (kinds email, ip, card, phone) are searched in every whole text and always stay. Three
generators of high recall propose further spans, which overlap each other and the shapes freely: any chain of seven
or more digits with separators (kind number), anything around an @, and words around a spelled-out "at" with a dot or "dot" behind it (both kind address). Format
and context of a proposal are binned into a cell: generator, digits, separators, opening, cue
words before it, character before it, form (dates, decimals, groups of a telephone number or card, brackets).

Proposals that overlap a valid shape are left to it: they neither teach nor count as results, so that what the trees add is their own.
Labels come from planted variants. Every valid shape of the corpus is rewritten, in its own
context, into forms that the shapes miss (local telephone numbers, cards with other separators, mail addresses that are spelled out), which
are personal, and into forms that are not (dates, ranges, decimals, amounts). Proposals that a hard
check refutes (checksum, octet range, too many digits, no letters beside the @) are not personal either. Other proposals have no label.
Labelled cases of all documents are counted by cell, label and half of the corpus (by hash of the text, so that copies are in one half);
the counts are at most four times as many as cells. Gradient-boosted trees learn from the one half. Per generator the score threshold is calibrated to a precision of
PRECISION by the other. All proposals in selected cells that no hard check refutes are results; a generator without cases in both halves has none.

Positions are found from the pieces between matches: `split` and `regexp_extract_all` see the same
matches, so sums of lengths give code-point offsets. They are gathered in stretches of STRETCH matches, so that a text with very many takes linear time. Possessive
quantifiers keep the expressions linear and iterative on very long texts. Null and empty texts have no spans; repeated rows are
handled alike; without labels of both sides (as in an empty table) only shapes are found.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, scratch

KINDS = ("email", "ip", "card", "phone", "number", "address")
SHAPES = KINDS[:4]
PRECISION = 0.95
#: Matches that are gathered at a time.
STRETCH = 256
SPAN = "struct<kind:string,start:int,end:int>"
PROPOSAL = "struct<kind:string,start:int,end:int,cell:int,refuted:boolean>"

_LOCAL = "A-Za-z0-9._%+-"
#: The shapes, fixed by contract, in a form that gives the same matches without backtracking.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators.
NUMBER = r"(?<![\p{L}\p{N}])[(]?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+"
ADDRESS = r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++"
_AT, _DOT = r"(?:\x20?[(\[{]at[)\]}]\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)"
SPELLED = rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"

CUES = ("phone|tel|call|mobile|fax|ruf|teléf", "card|visa|iban|account|karte|tarjeta|carte", "mail|contact|kontakt|write", "ip|host|server|address")
FEATURES = {"generator": 3, "digits": 8, "separators": 4, "opening": 3, "cue": 5, "before": 4, "form": 8}
#: Forms of proposals, the first that fits; none of them is 0.
FORMS = (
    r"^[(]?[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}$|^[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4}$",
    r"^[0-9]{1,3}(?:[.][0-9]{3})+$",
    r"^[0-9]+[-./][0-9]+$",
    r"^[0-9]{4}(?:[\x20./-]{1,2}[0-9]{4}){3}$",
    r"^[+]?[0-9]{0,3}\x20?[(]?[0-9]{2,4}[)]?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2,4}$",
    r"[(\[{](?:at|dot)[)\]}]",
    r"\x20(?:at|dot)\x20",
)


def _pieces(text: Column, pattern: str) -> Column:
    """Array of matches, each with the text between it and the one before; the last is what follows, without a match."""
    return F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda before, match: F.struct(before.alias("before"), match.alias("match")),
    )


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _found(text: Column, pattern: str, kind: str, ok, more=lambda s, before: [], shape: str = SPAN) -> Column:
    """Array of spans of the matches for which ok(match) holds; more(match, text before it) gives further fields."""
    none, lists = (F.expr(f"cast(array() as array<{x}>)") for x in (shape, f"array<{shape}>"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(F.lit(kind), start, end, *more(x["match"], x["before"])).cast(shape)
        out = F.when(x["match"].isNotNull() & ok(x["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def stretch(acc: Column, part: Column) -> Column:
        found = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _let(found, lambda f: F.struct(f["at"].alias("at"), F.concat(acc["out"], F.array(f["out"])).alias("out")))

    parts = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STRETCH).cast("int")), lambda i: F.slice(p, i * STRETCH + 1, F.lit(STRETCH)))
    return F.aggregate(_let(_pieces(text, pattern), parts), F.struct(F.lit(0).alias("at"), lists.alias("out")), stretch, lambda acc: F.flatten(acc["out"]))


def _where(needed: Column, spans: Column, shape: str = SPAN) -> Column:
    return F.when(needed, spans).otherwise(F.expr(f"cast(array() as array<{shape}>)"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def octets_ok(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))


def luhn_ok(digits: Column) -> Column:
    """Luhn's checksum; for at most 19 digits."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    place = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, doubled(place(i))).otherwise(place(i)))
    return F.when(n.between(1, 19), total % 10 == 0).otherwise(False)


def _card_ok(s: Column) -> Column:
    digits = F.translate(s, " -", "")
    return F.when(F.length(digits).between(12, 19), luhn_ok(digits)).otherwise(False)


def shape_spans(text: Column) -> Column:
    """All spans of the fixed shapes, by kind."""
    numbered = text.rlike("[0-9]")
    return F.concat(
        _where(F.contains(text, F.lit("@")), _found(text, EMAIL, "email", lambda s: F.lit(True))),
        _where(numbered, _found(text, IP, "ip", octets_ok)),
        _where(numbered, _found(text, CARD, "card", _card_ok)),
        _where(F.contains(text, F.lit("+")), _found(text, PHONE, "phone", lambda s: F.length(_digits(s)).between(9, 15))),
    )


def _bin(value: Column, lows: list[int]) -> Column:
    return sum(((value >= low).cast("int") for low in lows), F.lit(0))


def _cell(generator: int, s: Column, before: Column) -> Column:
    """The mixed-radix number of a proposal's features, in the order of FEATURES."""
    near = F.lower(F.right(before, F.lit(24)))
    digits = F.length(_digits(s))
    cue = F.lit(0)
    for i, words in reversed([*enumerate(CUES, 1)]):
        cue = F.when(near.rlike(words), i).otherwise(cue)
    last, form = F.right(before, F.lit(1)), F.lit(0)
    for i, pattern in reversed([*enumerate(FORMS, 1)]):
        form = F.when(s.rlike(pattern), i).otherwise(form)
    values = {
        "generator": F.lit(generator),
        "digits": _bin(digits, [1, 7, 9, 11, 14, 17, 20]),
        "separators": F.least(F.length(s) - F.length(F.regexp_replace(s, r"[\x20()./-]", "")), F.lit(3)),
        "opening": F.when(last == "+", 2).when(F.startswith(s, F.lit("(")), 1).otherwise(0),
        "cue": cue,
        "before": F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3),
        "form": form,
    }
    out = F.lit(0)
    for name, size in FEATURES.items():
        out = out * size + values[name]
    return out


def _refuted_number(s: Column) -> Column:
    digits = _digits(s)
    n = F.length(digits)
    plain = s.rlike(r"^[0-9\x20-]+$") & n.between(12, 19)
    octets = s.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    return F.when(octets, ~octets_ok(s)).when(plain, ~luhn_ok(digits)).otherwise(n > 19)


def _refuted_address(s: Column) -> Column:
    return ~F.substring_index(s, "@", -1).rlike(r"\p{L}") | ~F.substring_index(s, "@", 1).rlike(r"[\p{L}\p{N}]")


def proposals(text: Column) -> Column:
    """All proposals of the generators, with cell and whether a hard check refutes them."""
    any_ = lambda s: F.lit(True)
    return F.concat(
        _where(text.rlike("[0-9]"), _found(text, NUMBER, "number", any_, lambda s, b: [_cell(0, s, b), _refuted_number(s)], PROPOSAL), PROPOSAL),
        _where(F.contains(text, F.lit("@")), _found(text, ADDRESS, "address", any_, lambda s, b: [_cell(1, s, b), _refuted_address(s)], PROPOSAL), PROPOSAL),
        _where(text.rlike(r"[(\[{\x20]at[)\]}\x20]"), _found(text, SPELLED, "address", any_, lambda s, b: [_cell(2, s, b), F.lit(False)], PROPOSAL), PROPOSAL),
    )


def variants(text: Column) -> Column:
    """Planted cases: every valid shape of the text rewritten, as cell and label."""
    case = lambda generator, s, before, label: F.struct(_cell(generator, s, before).alias("cell"), F.lit(label).alias("label"))
    none = F.expr("cast(array() as array<struct<cell:int,label:double>>)")

    def of(pattern: str, needed: Column, ok, cases) -> Column:
        valid = F.filter(_pieces(text, pattern), lambda x: x["match"].isNotNull() & ok(x["match"]))
        return F.when(needed, F.flatten(F.transform(valid, lambda x: F.array(*cases(x["match"], x["before"]))))).otherwise(none)

    def of_phone(m: Column, before: Column) -> list[Column]:
        local = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*", "")
        bare = F.trim(F.regexp_replace(F.translate(local, "()", "  "), r"[\x20.-]+", " "))
        return [case(0, s, before, 1.0) for s in (local, bare, F.translate(bare, " ", "-"), F.translate(bare, " ", "."))] + _amounts(_digits(m), before)

    def of_card(m: Column, before: Column) -> list[Column]:
        fours = lambda sep: F.concat_ws(sep, *(F.substring(_digits(m), i, 4) for i in (1, 5, 9, 13)))
        return [case(0, fours(sep), before, 1.0) for sep in (".", "/", "  ")] + _amounts(_digits(m), before)

    def _amounts(d: Column, before: Column) -> list[Column]:
        two = lambda i: F.substring(d, i, 2)
        day = F.concat_ws("-", F.concat(F.lit("20"), two(1)), F.concat(F.lit("0"), F.substring(d, 3, 1)), F.concat(F.lit("1"), F.substring(d, 4, 1)))
        others = (day, F.translate(day, "-", "."), F.concat(F.lit("19"), two(1), F.lit("-20"), two(3)), F.concat(F.substring(d, 1, 4), F.lit("."), F.substring(d, 5, 4)), F.concat_ws(".", F.substring(d, 1, 2), F.substring(d, 3, 3), F.substring(d, 6, 3)))
        return [case(0, s, before, 0.0) for s in others]

    def of_email(m: Column, before: Column) -> list[Column]:
        name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        ways = ((" (at) ", "."), ("[at]", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"))
        return [case(2, F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))), before, 1.0) for at, dot in ways] + [case(2, F.concat(name, F.lit(" at "), host), before, 0.0)]

    numbered = text.rlike("[0-9]")
    return F.concat(
        of(PHONE, F.contains(text, F.lit("+")), lambda s: F.length(_digits(s)).between(9, 15), of_phone),
        of(CARD, numbered, _card_ok, of_card),
        of(EMAIL, F.contains(text, F.lit("@")), lambda s: F.lit(True), of_email),
    )


def _overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))


def selected_cells(docs: DataFrame, text: str = "text") -> list[int]:
    """Cells whose proposals are taken for personal data, learned from all documents.

    The list is at most as long as there are cells (product of FEATURES).
    """
    t = F.col("t")
    half = F.pmod(F.xxhash64(t), F.lit(2)).cast("int").alias("half")
    seen = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).select(half, shape_spans(t).alias("b"), proposals(t).alias("p"), variants(t).alias("v"))
    label = lambda b, p: F.when(p["refuted"] & ~_overlaps(b, p), 0.0)
    own = F.transform("p", lambda p: F.struct(p["cell"].alias("cell"), label(F.col("b"), p).alias("label")))
    one = seen.select("half", F.explode(F.concat(own, "v")).alias("x")).select("half", "x.cell", "x.label")
    with scratch(docs.sparkSession, "pii") as kept:
        cells, rest = kept.keep(one.groupBy("cell", "label", "half").agg(F.count("*").cast("double").alias("weight")), "cells"), F.col("cell")
        for name, size in reversed(FEATURES.items()):
            cells = cells.withColumn(name, (rest % size).cast("double"))
            rest = F.floor(rest / size)
        known = VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(cells).coalesce(1)
        train = known.where("label is not null and half = 0")
        if train.select("label").distinct().count() < 2:
            return []
        trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxDepth=4, maxIter=12, stepSize=0.3, minInstancesPerNode=1, seed=1, checkpointInterval=-1)
        scored = trees.fit(train).transform(known).select("cell", "generator", "label", "half", "weight", vector_to_array("probability")[1].alias("score"))
        down = Window.partitionBy("generator").orderBy(F.desc("score"))
        judged = F.col("label").isNotNull() & (F.col("half") == 1)
        good, all_ = (F.sum(F.when(judged, w).otherwise(0.0)).over(down) for w in (F.col("label") * F.col("weight"), F.col("weight")))
        calibrated = scored.withColumn("ok", F.when(all_ > 0, good / all_ >= PRECISION)).groupBy("generator").agg(F.min(F.when(F.col("ok"), F.col("score"))).alias("threshold"))
        chosen = scored.join(calibrated, "generator").where("score >= threshold and score > 0.5").select("cell").distinct()
        return sorted(r.cell for r in chosen.collect())


def find_personal_data(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with an array of spans (kind, start, end), by start, then kind in the order of KINDS."""
    cells = selected_cells(docs, text)
    t, b = free_name(docs, "pii_text"), free_name(docs, "pii_spans")
    base = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(b, shape_spans(F.col(t)))
    if cells:
        extra = F.filter(proposals(F.col(t)), lambda p: ~p["refuted"] & p["cell"].isin(cells) & ~_overlaps(F.col(b), p))
        extra = F.transform(extra, lambda p: F.struct(p["kind"], p["start"], p["end"]).cast(SPAN))
        base = base.withColumn(b, F.concat(b, extra))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(b, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"]).cast(SPAN))
    return base.withColumn(spans, ordered).drop(t, b)


def redact(found: DataFrame, text: str = "text", spans: str = "spans", redacted: str = "redacted") -> DataFrame:
    """found with a copy of the text in which spans are replaced by their kind in brackets; what overlaps goes as one, named by the first."""
    t = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]"))))
        apart = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, out).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return found.withColumn(redacted, whole)
