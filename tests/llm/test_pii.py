import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from stipple.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "", "write to a.b%c@mail7.example.com now", "a@b.c_x@d.e a@b.c@d.e x@y @z.w a@b..c é.q@u.v", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 79927398713 5500005555555559 1234567812345678901",
    "+1 (487) 555-7209 +1 23 +123456789012345678 +44 20 7946 0958. + 1 ++33.1.42.68.53.00", "😀 +49 (0)30 123456 x@é.de x@e.de 192.168.1.77",
    "9" * 30_000, "1 " * 5000 + "a@" * 5000, "a" * 50_000 + "@b.c", "." * 20_000, "call 555-123-4567 or (555) 123 4567", "1.1.1.1 " * 300,
]


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(P.KINDS):
        for m in re.finditer(PLAIN[kind], text, re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")),  # noqa: B023
                  "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()  # noqa: B023
            if ok:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, strict string")


def test_strict_spans_equal_brute_force(spark):
    rows = [*enumerate(TEXTS), (1, TEXTS[1]), (None, TEXTS[3]), (99, None)]
    found = P.proposed(frame(spark, rows))
    got = P.report(found, P.train(found)).collect()
    want = []
    for d, t in rows:
        b = brute(t or "")
        said = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in b)
        want.append((str(d), *(sum(x[0] == k for x in b) for k in range(4)), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    for r in got:
        t = dict(rows).get(r.doc_id) or ""
        assert {f"{P.KINDS[k]}:{s}:{e}" for k, s, e in brute(t)} <= set(r.spans.split(",")) | {""}
    assert P.report(P.proposed(frame(spark, rows).limit(0)), P.train(P.proposed(frame(spark, rows).limit(0)))).count() == 0


def test_boosting_finds_a_rule():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (300, 5))
    y = ((x[:, 1] > 1) & (x[:, 3] < 2)).astype(float)
    trees, start = P.boost(x[:200], y[:200] * 10, (1 - y[:200]) * 10)
    z = start + sum(P._answer(t, x[200:]) for t in trees)
    assert ((z > 0) == (y[200:] > 0)).mean() > 0.97
    t = P.calibrate(z, y[200:] * 10, (1 - y[200:]) * 10)
    chosen = z >= t
    assert y[200:][chosen].mean() >= P.PRECISION and P.calibrate(z[:0], y[:0], y[:0]) == float("inf")


def test_trees_as_expressions(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (60, len(P.FEATURES)))
    y = (x[:, 2] > 2).astype(float)
    trees, start = P.boost(x, y * 5, (1 - y) * 5)
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{f} int" for f in P.FEATURES))
    c = F.struct(*P.FEATURES)
    score = sum((P._expression(t, c) for t in trees), F.lit(start))
    want = start + sum(P._answer(t, x) for t in trees)
    assert np.allclose([r[0] for r in df.select(score).collect()], want)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or +1 (487) 555-7209!", 33, "x"), (2, None, 0, "y"), (3, "clean", 5, "z"),
                                (1, "mail a@b.cd or +1 (487) 555-7209!", 33, "x")], "doc_id bigint, text string, n_chars bigint, strict string")
    got = P.redact(df, size="n_chars")
    assert got.columns == df.columns and got.schema == df.schema
    rows = sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.text)
    assert rows == [(1, "mail [EMAIL] or [PHONE]!", 24), (1, "mail [EMAIL] or [PHONE]!", 24), (3, "clean", 5)] and got.count() == 4


def test_added_spans_on_planted_data(spark):
    rows = [(i, f"words and more +1 ({i % 900 + 100}) 555-{1000 + i} then words a{i}@mail.example.com and {i} items") for i in range(200)]
    rows += [(1000, "words and more (345) 555-8812 then words")]
    found = P.proposed(frame(spark, rows))
    model = P.train(found)
    assert np.isfinite(model.threshold)
    wide = {r.doc_id: len(r.wide) for r in found.collect()}
    assert wide[1000] == 1 and wide[5] >= 2
