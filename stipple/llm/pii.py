"""Personal data by gradient-boosted candidates, with DataFrame functions only.

High-recall generators propose spans that may overlap.  Each candidate is
described by small whole numbers of its format (digits, separators, check
digit, ...) and context (characters and cue words around it).  The rows of
equal features are counted, candidates that lie in a span of the strict rules
as positive, so that boosting works on a table bounded by the number of
feature values, whatever the number of documents.  Trees are evaluated as
column expressions; a threshold calibrated on documents that the trees have
not seen selects the redactions that join those of the strict rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import free_names
from stipple.llm.spans import joined, match_spans

KINDS = ("email", "ip", "card", "phone")
#: fixed values: the strict rules; possessive repeats and look-behinds change no match but keep the search linear
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: generators: what may be personal data of each kind
WIDE = {
    "email": r"(?:(?<![^\x09-\x0D\x20<>,;()])|\G)[^\x09-\x0D\x20<>,;()@]++@[^\x09-\x0D\x20<>,;()@]++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,}+",
    "phone": r"(?<![0-9A-Za-z])(?:\+|\(|)[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write)[\x20a-z]{0,8}[:=]?\x20?$", "ip": r"(?i)(?:ip|host|address|server)[\x20a-z]{0,8}[:=]?\x20?$",
    "card": r"(?i)(?:card|visa|account|payment)[\x20a-z]{0,8}[:=]?\x20?$", "phone": r"(?i)(?:phone|tel|call|fax|mobile)[\x20a-z]{0,8}[:=.]?\x20?$",
}
BEFORE, AFTER = 24, 2
FEATURES = ("kind", "digits", "length", "separators", "dots", "luhn", "octets", "domain", "lead", "prior", "next", "cue")
TREES, DEPTH, RATE = 24, 3, 0.4
PRECISION = 0.98
CALIBRATION_FOLDS = 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    places = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _octets(m: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return _octets(m)
    if kind == "card":  # long runs are out by their length alone, so the check sees few digits
        return F.when((n >= 16) & (n <= 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


#: a pattern without which a text has no match of the kind
_SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20./-]?[0-9]){7}", "phone": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}|\+[0-9]"}


def strict_spans(text: Column) -> Column:
    """Structs k, s, e of the strict rules' matches that pass their checks."""
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    parts = []
    for k, kind in enumerate(KINDS):
        found = F.filter(match_spans(text, STRICT[kind]), lambda x: _valid(kind, x["m"]))  # noqa: B023  read at once
        parts.append(F.when(text.rlike(_SIGN[kind]), _tagged(found, k)).otherwise(none))
    return F.concat(*parts)


def _tagged(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def _bin(value: Column, edges: list[int]) -> Column:
    """Number of edges that the value reaches."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value >= e, 1).otherwise(0)
    return out


def _one_of(value: Column, classes: list[str]) -> Column:
    """1 + the first class of characters that the value matches, 0 for none."""
    out = F.lit(0)
    for n, c in reversed(list(enumerate(classes))):
        out = F.when(value.rlike(c), n + 1).otherwise(out)
    return out


def _features(kind: int, m: Column, before: Column, after: Column) -> dict[str, Column]:
    """Whole numbers; the strict rules' own answer is not among them."""
    digits = _digits(m)
    n = F.length(digits)
    return {
        "kind": F.lit(kind),
        "digits": _bin(n, [4, 7, 8, 10, 12, 14, 16, 20]),
        "length": _bin(F.length(m), [8, 12, 16, 20, 28, 40]),
        "separators": _bin(F.length(F.regexp_replace(m, r"[^\x20()/-]", "")), [1, 2, 3, 4]),
        "dots": _bin(F.length(F.regexp_replace(m, r"[^.]", "")), [1, 2, 3, 4]),
        "luhn": F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(False).cast("int"),
        "octets": _octets(m).cast("int"),
        "domain": m.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)").cast("int"),
        "lead": _one_of(F.substring(m, 1, 1), [r"^\+", r"^\(", "^[0-9]", "^[A-Za-z]"]),
        "prior": _one_of(F.substring(before, -1, 1), [r"^[\x09-\x0D\x20]", "^[0-9]", "^[A-Za-z]", r"^\+", "^[(:=|]"]),
        "next": _one_of(F.substring(after, 1, 1), [r"^[\x09-\x0D\x20]", "^[0-9]", "^[A-Za-z]", "^[.,;)|]"]),
        "cue": before.rlike(CUES[KINDS[kind]]).cast("int"),
    }


def candidates(text: Column, strict: Column) -> Column:
    """Structs s, e, y (in a strict span of its kind) and the features of every candidate."""
    shape = "array<struct<s:int,e:int,y:boolean," + ",".join(f"{f}:int" for f in FEATURES) + ">>"
    none = F.array().cast(shape)

    def described(k: int, kind: str) -> Column:
        def one(x: Column) -> Column:
            start = F.greatest(x["s"] - BEFORE, F.lit(0))
            before = F.substring(text, start + 1, x["s"] - start)
            after = F.substring(text, x["e"] + 1, F.lit(AFTER))
            inside = F.exists(strict, lambda t: (t["k"] == k) & (t["s"] < x["e"]) & (x["s"] < t["e"]))
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), inside.alias("y"),
                            *[c.cast("int").alias(f) for f, c in _features(k, x["m"], before, after).items()])

        return F.transform(match_spans(text, WIDE[kind]), one)

    return F.concat(*[F.when(text.rlike(_SIGN[kind]), described(k, kind)).otherwise(none).cast(shape) for k, kind in enumerate(KINDS)])


def proposed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, strict spans and candidates of every row; a null text is an empty one."""
    whole = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    whole = whole.withColumn("strict", strict_spans(F.col("__t")))
    return whole.select(F.col(key), "strict", candidates(F.col("__t"), F.col("strict")).alias("wide"))


# --- boosting over counted feature rows ------------------------------------------------------------------------------


@dataclass
class Split:
    feature: int
    at: int  # values under it go left
    left: Split | float
    right: Split | float


@dataclass
class Model:
    trees: list[Split | float]
    start: float
    threshold: float  # of the sum of the trees


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Split | float:
    """A regression tree by second-order gain over gradients g and weights h."""
    gs, hs = g[rows].sum(), h[rows].sum()
    best, gain = None, 1e-6
    if depth:
        for f in range(x.shape[1]):
            values = x[rows, f]
            n = values.max(initial=0) + 1
            gl, hl = np.cumsum(np.bincount(values, g[rows], n))[:-1], np.cumsum(np.bincount(values, h[rows], n))[:-1]
            got = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
            if got.size and got.max() > gain:
                gain, best = got.max(), (f, int(got.argmax()) + 1)
    if best is None:
        return float(-RATE * gs / (hs + 1))
    left = x[rows, best[0]] < best[1]
    return Split(*best, _grow(x, g, h, rows[left], depth - 1), _grow(x, g, h, rows[~left], depth - 1))


def _answer(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] < tree.at, _answer(tree.left, x), _answer(tree.right, x))


def boost(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[list[Split | float], float]:
    """Trees of logistic boosting on distinct feature rows with their counts."""
    n = positive + negative
    start = float(np.log((positive.sum() + 0.5) / (negative.sum() + 0.5)))
    z = np.full(len(x), start)
    trees: list[Split | float] = []
    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, n * p - positive, n * p * (1 - p), np.arange(len(x)), DEPTH)
        trees.append(tree)
        z += _answer(tree, x)
    return trees, start


def calibrate(z: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The least score from which on the precision stays at its target; infinite where none does."""
    order = np.argsort(-z, kind="stable")
    right, wrong = np.cumsum(positive[order]), np.cumsum(negative[order])
    last = np.append(z[order][1:] != z[order][:-1], True) if len(z) else np.zeros(0, bool)
    good = last & (right > 0) & (right >= PRECISION * (right + wrong))
    return float(z[order][good].min()) if good.any() else float("inf")


def train(found: DataFrame, key: str = "doc_id") -> Model:
    """Boost on the counts of all candidates outside the calibration fold, calibrate on those inside.

    The driver gets one row for each combination of feature values that
    occurs; the values bound their number, not the documents.
    """
    fold = F.pmod(F.xxhash64(key), F.lit(CALIBRATION_FOLDS)) == 0
    counts = (found.select(fold.alias("fold"), F.explode("wide").alias("c")).groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
              .agg(F.sum(F.col("c.y").cast("bigint")).alias("positive"), F.count(F.lit(1)).alias("n")).collect())
    counts.sort(key=tuple)
    x = np.array([[r[f] for f in FEATURES] for r in counts], np.int64).reshape(-1, len(FEATURES))
    positive, n = (np.array([r[c] for r in counts], float) for c in ("positive", "n"))
    inside = np.array([bool(r["fold"]) for r in counts], bool)
    if not (~inside).any() or not inside.any():
        inside = np.zeros(len(x), bool)
    trees, start = boost(x[~inside], positive[~inside], (n - positive)[~inside])
    held = inside if inside.any() else ~inside
    z = start + sum((_answer(t, x[held]) for t in trees), np.zeros(held.sum()))
    return Model(trees, start, calibrate(z, positive[held], (n - positive)[held]))


def _expression(tree: Split | float, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(c[FEATURES[tree.feature]] < tree.at, _expression(tree.left, c)).otherwise(_expression(tree.right, c))


def selected(model: Model, strict: Column, wide: Column) -> Column:
    """Structs k, s, e: the strict spans, and the chosen candidates that touch none of their kind."""
    if not np.isfinite(model.threshold):
        return strict

    def chosen(c: Column) -> Column:
        score = F.lit(model.start)
        for t in model.trees:
            score = score + _expression(t, c)
        return ~c["y"] & (score >= model.threshold)

    more = F.transform(F.filter(wide, chosen), lambda c: F.struct(c["kind"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    return F.concat(strict, more)


def report(found: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, counts and digest of the strict spans, and all selected spans as text."""
    def count(k: int) -> Column:
        return F.size(F.filter("strict", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    return found.select(
        F.col(key), *map(count, range(len(KINDS))),
        F.sha2(joined(F.col("strict"), KINDS, False).cast("binary"), 256).alias("base_sha256"),
        joined(selected(model, F.col("strict"), F.col("wide")), KINDS, False).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, x: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, x["s"] - done["at"])
        new = F.struct(x["e"].alias("at"), F.concat(done["out"], F.array(kept, names[x["k"]])).alias("out"))
        more = F.struct(F.greatest(done["at"], x["e"]).alias("at"), done["out"].alias("out"))
        return F.when(x["s"] >= done["at"], new).otherwise(more)

    end = F.aggregate(ordered, start, step, lambda d: F.concat(
        F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text) - d["at"])))
    return F.when(F.size(spans) > 0, end).otherwise(text)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = None) -> DataFrame:
    """``docs`` with the spans in their texts replaced and, where named, the column of sizes renewed for changed texts.

    Every row and column stays, under any name; a null text stays null, an
    empty one empty, an empty table empty.  Repeated rows are treated alike.
    """
    whole, strict, spans, new = free_names(docs.columns, "whole", "strict", "spans", "new")
    model = train(proposed(docs, key, text), key)
    marked = docs.withColumn(whole, F.coalesce(F.col(text), F.lit(""))).withColumn(strict, strict_spans(F.col(whole)))
    marked = marked.withColumn(spans, selected(model, F.col(strict), candidates(F.col(whole), F.col(strict))))
    marked = marked.withColumn(new, F.when(F.col(text).isNotNull(), redacted(F.col(text), F.col(spans))))
    out = {text: F.col(new)}
    if size:
        changed = F.size(spans) > 0
        out[size] = F.when(changed, F.length(new).cast(docs.schema[size].dataType)).otherwise(F.col(size))
    return marked.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
