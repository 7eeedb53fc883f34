import hashlib
import zlib

import pytest

from stipple.llm import merkle
from stipple.session import cut

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, lo bigint, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return sha("".join(field(v) for v in (r[0], r[3], r[2], r[4], text)))


def climb(hashes):
    """(root, for every leaf its steps) of one tree, by plain lists."""
    steps = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for i, a in enumerate(at):
            run = a // 3 * 3
            steps[i].append(("".join(hashes[run:a]), "".join(hashes[a + 1:run + 3])))
        hashes = [sha("".join(hashes[i:i + 3])) for i in range(0, len(hashes), 3)]
        at = [a // 3 for a in at]
    return hashes[0], steps


def brute(rows):
    if not rows:
        return []
    groups = {}
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        other = r[1].replace("\n", "") if even and r[1] is not None else r[1]
        groups.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, other)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[g] = climb([x[1] for x in groups[g]])
    root, tops = climb([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (key, first, other), steps in zip(groups[g], trees[g][1]):
            acc = other
            for a, b in steps + top:
                acc = sha(a + acc + b)
            out.append((key, first, trees[g][0], root, sha("".join(a + b for a, b in steps + top)), acc, acc == root))
    return out


def check(spark, rows):
    docs = cut(spark.createDataFrame(rows, DDL).repartition(3), "fixture")
    got = [tuple(r) for r in merkle.audit(docs, {"text": merkle.tampered_text()}).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def test_against_plain_lists(spark):
    rows = [(i, f"text {i}\nline\n" * (i % 4), "en", f"s{i % 5}" if i % 7 else "hot", i * 3, "x", 1, "y") for i in range(120)]
    rows += [(1000 + i, "a\nb", "de", "hot", 3, None, None, None) for i in range(100)]
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}


def test_nulls_ties_repeats_and_odd_names(spark):
    rows = [(None, "a\nb", "en", "s", 3, "t", 0, "p"), (5, None, None, None, None, None, None, None),
            (5, None, None, None, None, None, None, None), (5, "", "", "", 0, "", 0, ""), (5, "\n", None, "é", 1, "t", 9, "p"),
            (6, "\n" * 3, "en", "=", -1, "t", 2, "p"), (6, "\n" * 4, "en", "=", -1, "t", 2, "p"), (4, "long " * 60_000, "en", "s", 300_000, "", 1, "")]
    rows += [(9, "same\n", "en", "s", 5, "t", 0, "p")] * 40
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, n):
    check(spark, [(i, "x\ny", "en", "s" if i else None, 3, "", 0, "") for i in range(n)])


def test_copies_beyond_one_array(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 8)
    check(spark, [(2, "w\nw", "en", "s", 3, "", 0, "")] * 27)


def test_numbering_does_not_depend_on_the_partitions(spark):
    rows = [(i, str(i), "en", "s" if i % 3 else "t", i, "", 0, "") for i in range(300)]
    a = merkle.manifest(spark.createDataFrame(rows, DDL)).select("doc_id", "leaf", "root").collect()
    b = merkle.manifest(spark.createDataFrame(rows[::-1], DDL).repartition(11)).select("doc_id", "leaf", "root").collect()
    assert sorted(a) == sorted(b)
