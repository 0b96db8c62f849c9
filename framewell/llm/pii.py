"""Personal data by candidate gradient boosting, with DataFrame operations only.

Generators propose spans with high recall; they may overlap. Spans of the four base kinds that pass their checks always
count. Every candidate gets coarse features of its format and its context. Boosted trees learn, from counts over all
candidates, whether a candidate passes the strict check of its kind; the features leave that check out, so that the
trees also judge forms which no check covers (numbers without a plus sign, masked addresses, keys). For each kind a
threshold is set on held-out documents to reach ``precision``; candidates above it are added.

Places come from the pieces between matches: a pattern's matches and the gaps that it splits a text into alternate, so
their lengths add up to code-point positions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.llm.boosting import Trees, threshold
from framewell.llm.shared import BROADCAST_ROWS, free_names, stash

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["iban", "secret"]
#: Each base pattern is equal to its plain form, but starts once in a run (or where the last match ended) and never
#: goes back into one, so a long run costs its length and not the square.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider generators.
MASKED = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[(\[]\x20?at\x20?[)\]]\x20?[a-z0-9-]{1,64}+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[a-z0-9-]{1,64}+){1,4}"
LOCAL = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"""(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\x20?[:=]\x20?["']?[a-z0-9/+_=-]{8,}+"""
FEATURES = ["f_kind", "f_form", "f_length", "f_digits", "f_upper", "f_marks", "f_before", "f_after", "f_cue"]
FOUND = "array<struct<kind: string, form: int, start: int, end: int, value: string, valid: boolean, before: string, after: string>>"


@dataclass(frozen=True)
class PiiScan:
    precision: float = 0.95
    context: int = 24


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


GENERATORS: list[tuple[str, int, str, str, Callable[[Column], Column]]] = [
    ("email", 0, EMAIL, "@", lambda v: F.lit(True)),
    ("ip", 0, IP, r"[0-9]\.[0-9]", _octets),
    ("card", 0, CARD, r"[0-9][\x20-]?[0-9]", _card),
    ("phone", 0, PHONE, r"\+[0-9]", lambda v: F.length(_digits(v)).between(9, 15)),
    ("email", 1, MASKED, r"(?i)[(\[]\x20?at\x20?[)\]]", lambda v: v.rlike(r"(?i)[.)\]]\x20?[a-z]{2,24}$")),
    ("phone", 1, LOCAL, "[0-9]{3}[\\x20.-][0-9]{4}", lambda v: ~_digits(v).rlike("^[01]")),
    ("iban", 1, IBAN, "[A-Z]{2}[0-9]{2}", lambda v: F.length(F.regexp_replace(v, " ", "")).between(15, 34)),
    ("secret", 1, SECRET, r"(?i)(?:token|secret|passw|key)\x20?[:=]", lambda v: v.rlike("[0-9]") & v.rlike("[:=]\\x20?[\"']?[A-Za-z0-9/+_=-]{16,}")),
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Matches whose places are summed up at once: a list grown in one go would be copied at each match.
RUN = 64


def matches(text: Column, kind: str, form: int, pattern: str, check: Callable[[Column], Column], context: int) -> Column:
    """All matches of one pattern in a text, with code-point places and what stands around them.

    A match starts at the running sum of the lengths of gaps and matches before it. Sums are taken within runs of
    :data:`RUN` matches and over the runs, so a text costs its matches and not their square.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def paired(x: Column) -> Column:
        """The matches with what stands before and after, and the lengths to sum up."""
        n = F.size(x["values"])
        after = F.slice(x["gaps"], F.lit(2), n)
        found = F.zip_with(F.slice(x["gaps"], F.lit(1), n), x["values"], lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("length"), v.alias("value"), F.right(g, F.lit(context)).alias("before")))
        return F.zip_with(found, after, lambda f, a: F.struct(f.alias("f"), F.left(a, F.lit(1)).alias("after")))

    def placed(all_: Column) -> Column:
        run = lambda i: F.slice(all_, i * RUN + 1, F.lit(RUN))
        runs = F.sequence(F.lit(0), F.ceil(F.size(all_) / RUN).cast("int") - 1)
        sums = F.transform(runs, lambda i: F.aggregate(run(i), F.lit(0), lambda s, x: s + x.f.gap + x.f.length))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, begin, lambda s, n: F.struct((s.at + n).alias("at"), F.array_append(s.out, s.at).alias("out")), lambda s: s.out)

        def step(s: Column, x: Column) -> Column:
            start = s.at + x.f.gap
            found = F.struct(F.lit(kind).alias("kind"), F.lit(form).alias("form"), start.alias("start"), (start + x.f.length).alias("end"), x.f["value"].alias("value"), check(x.f["value"]).alias("valid"), x.f.before.alias("before"), x.after.alias("after"))
            return F.struct((start + x.f.length).alias("at"), F.array_append(s.out, found).alias("out"))

        within = lambda i, at: F.aggregate(run(i), F.struct(at.alias("at"), F.array().cast(FOUND).alias("out")), step, lambda s: s.out)
        return F.when(F.size(all_) > 0, _let(starts, lambda at: F.flatten(F.transform(runs, lambda i: within(i, F.get(at, i))))))

    return _let(parts, lambda x: _let(paired(x), placed))


def candidates(documents: DataFrame, conf: PiiScan) -> DataFrame:
    """All generators' spans by distinct (doc_id, text_hash)."""
    lists = [F.coalesce(F.when(F.col("text").rlike(hint), matches(F.col("text"), kind, form, pattern, check, conf.context)), F.array().cast(FOUND)) for kind, form, pattern, hint, check in GENERATORS]
    return documents.select("doc_id", "text_hash", F.explode(F.concat(*lists)).alias("c")).select("doc_id", "text_hash", "c.*").distinct()


def _class(char: Column) -> Column:
    """0: nothing, 1: white space, 2: letter, 3: digit, 4: another sign."""
    return F.when(char.isNull() | (char == ""), 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"\p{L}"), 2).when(char.rlike("[0-9]"), 3).otherwise(4)


def _steps(value: Column, *bounds: float) -> Column:
    return sum((F.when(value >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def features(found: DataFrame) -> DataFrame:
    value, length = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / length
    kind = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS + EXTRA)), F.lit(0))
    return found.select(
        "*", kind.alias("f_kind"), F.col("form").alias("f_form"),
        _steps(length, 7, 9, 11, 13, 15, 17, 20, 25, 33).alias("f_length"), _steps(share("[^0-9]"), 0.01, 0.3, 0.6, 0.8, 1.0).alias("f_digits"),
        _steps(share("[^A-Z]"), 0.01, 0.3).alias("f_upper"), _steps(F.length(F.regexp_replace(value, r"[\p{L}0-9]", "")), 1, 2, 3, 4, 6).alias("f_marks"),
        _class(F.right("before", F.lit(1))).alias("f_before"), _class(F.col("after")).alias("f_after"),
        F.when(F.col("before").rlike(r"(?i)(?:mail|call|phone|tel|card|visa|address|contact|server|host|iban|account|key|token)\W*$"), 1).otherwise(0).alias("f_cue"),
    )


def train(found: DataFrame, conf: PiiScan) -> tuple[Trees, dict[str, float]]:
    """Trees and, for each kind, a threshold for its wider form, from counts over all candidates.

    A fifth of the documents only sets thresholds. Candidates of the base form count by their check alone, so they set none;
    a kind of whose wider form no candidate is held out gets a threshold that nothing reaches."""
    fold = (F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(5)) == 0).cast("int").alias("held_out")
    counts = found.groupBy(*FEATURES, fold).agg(F.count_if("valid").alias("good"), F.count("*").alias("n")).orderBy(*FEATURES, "held_out").collect()
    x = np.array([[r[f] for f in FEATURES] for r in counts], dtype=np.int64).reshape(-1, len(FEATURES))
    held, good, n = (np.array([r[k] for r in counts], dtype=np.float64) for k in ("held_out", "good", "n"))
    model = Trees(FEATURES).fit(x[held == 0], good[held == 0], n[held == 0])
    score = model.predict(x)
    bounds = {}
    for i, kind in enumerate(KINDS + EXTRA):
        mine = (held == 1) & (x[:, 0] == i) & (x[:, 1] == 1)
        bounds[kind] = threshold(score[mine], good[mine], n[mine], conf.precision)
    return model, bounds


def find(documents: DataFrame, conf: PiiScan = PiiScan()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, text_hash, base and spans, arrays of (kind order, start, end, kind, score).

    ``base``: validated matches of the four base kinds. ``spans``: these and the candidates that the trees select and that
    do not lie inside a base span. A null or empty text has none. Repeated rows, and rows without a doc_id, each get the
    full result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = stash(features(candidates(docs, conf)))
    model, bounds = train(found, conf)
    bound = sum((F.when(F.col("kind") == k, F.lit(b)).otherwise(F.lit(0.0)) for k, b in bounds.items()), F.lit(0.0))
    base = F.col("valid") & (F.col("form") == 0)
    chosen = found.withColumn("score", model.column()).withColumn("base", base).filter(base | ((F.col("score") >= bound) & (F.col("form") == 1)))
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"), F.desc("base")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = chosen.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(before)).filter(F.col("base") | F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    span = F.struct(F.col("f_kind").alias("rank"), "start", "end", "kind", "score")
    each = chosen.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.array_sort(F.collect_set(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("spans"))
    none = F.array().cast("array<struct<rank: int, start: int, end: int, kind: string, score: double>>")
    out = docs.select("doc_id", "text_hash").join(each, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return out.select("doc_id", "text_hash", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(documents: DataFrame, conf: PiiScan = PiiScan()) -> DataFrame:
    """``documents`` with every span of :func:`find` replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    All rows and columns stay, whatever further columns are named; null and empty texts stay as they are.
    """
    row_id, row_hash, found = free_names(documents, "row_id", "row_hash", "row_spans")
    hit = stash(find(documents, conf).filter(F.size("spans") > 0).select(F.col("doc_id").alias(row_id), F.col("text_hash").alias(row_hash), F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))).alias(found)).distinct())
    side = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS // 10 else hit
    both = documents.join(side, documents["doc_id"].cast("long").eqNullSafe(F.col(row_id)) & (F.xxhash64(documents["text"]) == F.col(row_hash)), "left")
    text = F.col("text")

    all_ = F.col(found)
    run = lambda i: F.slice(all_, i * RUN + 1, F.lit(RUN))
    runs = F.sequence(F.lit(0), F.ceil(F.size(all_) / RUN).cast("int") - 1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    far = F.transform(runs, lambda i: F.array_max(F.transform(run(i), lambda s: s.end)))
    done = F.aggregate(far, begin, lambda s, e: F.struct(F.greatest(s.at, e).alias("at"), F.array_append(s.out, s.at).alias("out")), lambda s: F.array_append(s.out, s.at))

    def cleaned(i: Column, first: Column, last: Column) -> Column:
        """The text from ``first`` to ``last`` with the spans of run ``i`` replaced."""

        def step(part: Column) -> Column:
            def put(state: Column, s: Column) -> Column:
                gap = F.substring(part, state.at - first + 1, F.greatest(s.start - state.at, F.lit(0)))
                parts = F.when(s.start >= state.at, F.concat(state.out, F.array(gap, F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))))).otherwise(state.out)
                return F.struct(F.greatest(state.at, s.end).alias("at"), parts.alias("out"))

            start = F.struct(first.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(run(i), start, put, lambda s: F.array_join(s.out, ""))

        return _let(F.substring(text, first + 1, last - first), step)

    clean = _let(done, lambda at: F.concat(F.array_join(F.transform(runs, lambda i: cleaned(i, F.get(at, i), F.get(at, i + 1))), ""), F.substring(text, F.get(at, F.size(at) - 1) + 1, F.length(text))))
    return both.withColumn("text", F.when(F.col(found).isNull(), text).otherwise(clean)).select(*[F.col(f"`{c}`") for c in documents.columns])
