"""Whitening, URL filters and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from cliploom.llm import merkle, url_filter, whitening
from cliploom.llm.common import table
from cliploom.llm.queries import ORACLE, QUERIES, URL_RULES

# --- whitening -------------------------------------------------------------------


def plain_whitening(rows, k=4):
    """(vec_id, component) -> (deviation, whitened, explained) by LAPACK."""
    fine = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and v]
    x = {(i, at): tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for at, (i, v) in enumerate(fine)}
    distinct = np.array(sorted(set(x.values())), float)
    n, total = len(distinct), [sum(c) for c in zip(*set(x.values()), strict=True)]
    centred = distinct - np.array(total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-12 * values.sum()).sum()))
    out = []
    for (i, _), row in x.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True))
        for j in range(k):
            out.append((i, j + 1, n, deviation, (np.array(row) - np.array(total) / n) @ vectors[:, j] / values[j] ** 0.5, values[j] / values.sum()))
    return out


def same_whitening(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for j in {r[1] for r in want}:
        ours, theirs = ([r for r in rows if r[1] == j] for rows in (got, want))
        sign = np.sign(np.dot([r[4] for r in ours], [r[4] for r in theirs]))
        np.testing.assert_allclose([r[4] for r in ours], [sign * r[4] for r in theirs], rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose([r[5] for r in ours], [r[5] for r in theirs], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def vectors(spark, rows):
    rows = [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id bigint, embedding array<float>, x string, n int").repartition(5)


def test_whitening_of_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, sf_dir, "embeddings").collect()]
    same_whitening(QUERIES["op11_feast_whitening"](spark, sf_dir).collect(), plain_whitening(rows))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(300, 400)] + [rows[1], rows[1], (None, rows[2][1])]
    rows += [(500, None), (501, [1.0, None, 1, 1, 1, 1]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (505, [-0.0] * 6)]
    same_whitening(whitening.whitened(vectors(spark, rows)).collect(), plain_whitening(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(vectors(spark, rows)).collect() == []


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20
    same_whitening(got, plain_whitening(rows))


def test_huge_entries_and_lengths(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 3.0]), (3, [1e15, 2.0])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in got)
    with pytest.raises(ValueError, match="different lengths"):
        whitening.whitened(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


@pytest.mark.parametrize("seed", range(4))
def test_leading_eigenpairs(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 40))
    x[:, 0] *= 60  # one far above a dense rest
    x[:, 2] = x[:, 1] + 1e-4 * rng.normal(size=150)
    matrix = np.cov(x.T)
    values, found = whitening.leading(matrix, 7)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(matrix)[::-1][:7], rtol=1e-12)
    np.testing.assert_allclose(found @ found.T, np.eye(7), atol=1e-13)
    np.testing.assert_allclose(matrix @ found.T, found.T * values, atol=1e-10)


def test_equal_eigenvalues_and_inertia():
    matrix = np.diag([3.0, 3, 3, 1, 1, 0])
    values, found = whitening.leading(matrix, 4)
    np.testing.assert_allclose(values, [3, 3, 3, 1], rtol=1e-12)
    np.testing.assert_allclose(matrix @ found.T, found.T * values, atol=1e-12)
    assert whitening.inertia(*whitening.tridiagonal(matrix), np.array([-1, 0.5, 2, 4])).tolist() == [0, 1, 3, 6]
    with pytest.raises(ArithmeticError):
        whitening.feast(matrix, 0.5, 4.0, 4)  # there are five


# --- URL filters -------------------------------------------------------------------


def plain_verdict(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, after = rest[:end], rest[end:]
        path = after[: min([after.index(c) for c in "?#" if c in after], default=len(after))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    name = host.removeprefix("www.") + path.rstrip("/") if host else None
    rule = max(fits)[2:] if fits else (None, None)
    return host, path, rule[0], rule[1] or ("block" if name in listed else "allow")


URLS = [
    None, "", "no url", "://", "http://", "http://a.net", "http://a.net/", "HTTP://X.A.NET/en/x?y#z", "http://net/", "http://example.net/en/",
    "http://www.example.net/en/1", "http://notexample.net/en/1", "http://example.com/de/?q", "http://example.com/DE/", "http://org/fr/",
    "http://x.org/fr", "http://x.org#/fr/", "http://x.org?a://b.net/", "x://y://z.net/", "http://Ä.NET/ß", "http://.net/", "http://net./",
    "http://bad.test/a/", "http://www.bad.test/a", "https://BAD.test/a?x", "http://bad.test/b", "http://bad.test//a", "http://a\nb.net/\n?",
    "http://" + "a." * 500 + "net/" + "x/" * 5000, "http://example.net:80/en/", "http://u@example.net/en/",
]


def test_url_verdicts(spark):
    rules = [*URL_RULES, ("allow", "bad.test", "/b"), ("block", "Z.net", ""), ("allow", "z.net", ""), ("block", "a.b.c", "/x"), ("allow", "c", "/x/y"),
             ("allow", None, "/"), ("block", "", "/"), ("block", "x.org", None), ("allow", "netx", ""), ("block", "net", "x")]
    urls = [*URLS, "http://a.b.c/x", "http://a.b.c/x/y", "http://a.b.c/x/yz", "http://b.c/x/y", "http://netx/"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(3, urls[6]), (3, urls[6]), (None, urls[6])]
    pages = spark.createDataFrame([(*r, "h", "r", True) for r in rows], "page_id bigint, url string, host string, rule string, listed boolean").repartition(4)
    listed = spark.createDataFrame([("http://bad.test/a", 1), ("http://bad.test/a/", 1), ("http://bad.test/b", 1), (None, 1), ("junk", 1), ("http://q.net/", 1)], "url string, path int")
    table_ = spark.createDataFrame(rules, "action string, host string, path string")
    got = url_filter.judge(pages, table_, listed).collect()
    lowered = [(a, h and h.lower(), p) for a, h, p in rules if h and p is not None]
    want = [(i, *plain_verdict(u, lowered, {"bad.test/a", "bad.test/b", "q.net"})) for i, u in rows]
    key = lambda r: (r[0] is None, r[0] or 0, repr(r))
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("empty", ["pages", "rules", "listed"])
def test_empty_tables_of_the_filter(spark, empty):
    tables = {
        "pages": spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string"),
        "rules": spark.createDataFrame([("block", "net", "/")], "action string, host string, path string"),
        "listed": spark.createDataFrame([("http://b.net/",)], "url string"),
    }
    tables[empty] = tables[empty].limit(0)
    got = [(r.rule, r.verdict) for r in url_filter.judge(**tables).collect()]
    assert got == {"pages": [], "rules": [(None, "allow")], "listed": [("net/", "block")]}[empty]


def test_bloom_filter_has_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).checkpoint()
    bloom = url_filter.bloom_filter(keys)
    assert url_filter.possible(keys, bloom).count() == 20_000
    others = spark.range(50_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert url_filter.possible(others, bloom).count() < 0.03 * 50_000


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_url_query_equals_sql_and_stays_in_the_jvm(spark, sf_dir, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        found = QUERIES["op12_url_filter"](spark, sf_dir)
        assert differences(found, connect(sf_dir), ORACLE["op12_url_filter"]) == []
        plan = found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


# --- Merkle manifest -----------------------------------------------------------------


def h(parts):
    return hashlib.sha256(parts.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_siblings(levels, place):
    out = []
    for level in levels[:-1]:
        first = place - place % 8
        out.append((level[first:place], level[place + 1 : first + 8]))
        place //= 8
    return out


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, siblings, copies) of (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    trees, own = {}, {}
    for lang in {r[2] for r in rows}:
        own[lang] = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = plain_tree([leaf(r) for r in own[lang]])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    upper, out = plain_tree([trees[x][-1][0] for x in order]), []
    for at, lang in enumerate(order):
        for i, r in enumerate(own[lang]):
            path = plain_siblings(trees[lang], i) + plain_siblings(upper, at)
            flat = [x for pair in path for side in pair for x in side]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            nodes = [leaf((*r[:4], lowered(r[4])) if tampered else r)]
            for left, right in path:
                nodes.append(h("".join([*left, nodes[-1], *right])))
            out.append((r[0], leaf(r), trees[lang][-1][0], upper[-1][0], h("".join(flat)), nodes[-1], flat, nodes if tampered else None))
    return sorted(out, key=repr)


def found_manifest(spark, rows):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, place string, digest string"
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema).repartition(5)
    edits = {"text": F.translate("text", url_filter.UPPER, url_filter.LOWER)}
    found = merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, edits=edits)
    got = merkle.proofs(found, whole=True).collect()
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.siblings, r.copies) for r in got], key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65, 513, 1300])
def test_manifest_equals_plain(spark, n):
    rows = [(i * 7 % 2000, "s", "en", 3, f"Text A {i}") for i in range(n)]
    assert found_manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    langs = [None, "", "é", "z", "en", "\U0001f600", *(f"l{i}" for i in range(20))]
    rows = [(i, "s" if i % 3 else None, langs[i % len(langs)], None if i % 4 == 0 else i, [None, "", "ABÉ", "x:1"][i % 4]) for i in range(700)]
    rows += [(9, "s", "en", 1, "Same")] * 40 + [(9, "s", "en", 1, "Other")] + [(None, None, None, None, None)] * 3 + [(None, "s", "en", 1, "A" * 300_000)]
    assert found_manifest(spark, rows) == plain_manifest(rows)


def test_a_version_shares_all_but_its_path():
    tree = merkle.BlockTree([h(str(i)) for i in range(100)], 3)
    before = [list(level) for level in tree.levels]
    version = merkle.copies(h("changed"), tree.siblings(70))
    assert tree.levels == before and len(version) == 4
    changed = [h(str(i)) if i != 70 else h("changed") for i in range(100)]
    other = merkle.BlockTree(changed, 3)
    differs = [(k, i) for k, level in enumerate(other.levels) for i, x in enumerate(level) if x != tree.levels[k][i]]
    assert differs == [(0, 70), (1, 8), (2, 1), (3, 0)] and [other.levels[k][i] for k, i in differs] == version


def test_manifest_query_equals_sql(spark, sf_dir):
    found = QUERIES["op13_merkle_manifest"](spark, sf_dir)
    assert differences(found, connect(sf_dir), ORACLE["op13_merkle_manifest"]) == []
