"""Periodic runs, contextual extraction and the Merkle manifest against plain Python, on the tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, WORD, awkward_rows, rows_of, same, sha

from tapewright.llm import contextual_pii, merkle_manifest, periodic_runs
from tapewright.llm.columns import id_checksum
from tapewright.llm.queries import QUERIES


def checksum(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


@pytest.fixture(scope="module")
def awkward_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("awkward")
    # without the columns whose names clash with results, op13 still needs its five
    spark.createDataFrame(awkward_rows(), SCHEMA).withColumn("rank", F.lit("x")).withColumn("group", F.lit(1)).repartition(3).write.parquet(
        f"{folder}/documents.parquet"
    )
    return str(folder)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def answers(spark, folder, name):
    return [tuple(r) for r in QUERIES[name](spark, folder).collect()]


def rows_in(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_contextual_pii", "op13_merkle_manifest"])
def test_empty_table(name, spark, empty_dir, sf_dir):
    found = QUERIES[name](spark, empty_dir)
    assert found.count() == 0 and found.schema.simpleString() == QUERIES[name](spark, sf_dir).schema.simpleString()


# --- periodic runs -------------------------------------------------------------------------------------------------


def runs_of_words(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > begin and i + q - begin >= max(6, 4 * q):
                found.setdefault((begin, i + q), q)
            i += i == begin
    return sorted((s, e - s, q) for (s, e), q in found.items())


def rewritten(doc_id, words):
    h, n = checksum(doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_row(doc_id, text):
    words = rewritten(doc_id, WORD.findall(text or ""))
    runs = sorted(runs_of_words(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(((-length, s, q) for s, length, q in runs), default=None)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, sha(lines.encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()))


def test_cover_has_every_difference():
    assert {(a - b) % periodic_runs.MODULUS for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.MODULUS))


def test_extensions_and_runs_of_random_rows(monkeypatch):
    rng = random.Random(7)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.choice([0, 1, 5, 6, 7, 30, 150]), rng.choice([1, 2, 3, 40])
            doc = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                p = rng.randint(1, max(1, n // 4))
                doc = [doc[i % p] for i in range(n)]
            docs.append(doc)
        monkeypatch.setattr(periodic_runs, "BLOCK", rng.choice([40, 1_000_000]))
        edges = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        start, end, q = periodic_runs.find_runs(np.array([x for d in docs for x in d], np.int64), edges)
        wanted = [(s + edges[i], length, p) for i, d in enumerate(docs) for s, length, p in runs_of_words(d)]
        assert sorted(zip(start, end - start, q, strict=True)) == sorted(wanted)
        text = np.array([*docs[0], 99], np.int64)
        pairs = [(i, j) for i in range(len(text)) for j in range(i + 1, len(text))][:500]
        if pairs:
            i, j = map(np.array, zip(*pairs, strict=True))
            direct = [next(k for k in range(len(text)) if text[x + k] != text[y + k]) for x, y in pairs]
            assert periodic_runs.CommonExtensions(text)(i, j).tolist() == direct


def test_runs_of_documents(spark, awkward_dir):
    same(answers(spark, awkward_dir, "op11_periodic_runs"), [run_row(r["doc_id"], r["text"]) for r in rows_in(spark, awkward_dir) if len(r["text"] or "") < 20_000]
         + [t for t in answers(spark, awkward_dir, "op11_periodic_runs") if t[0] == 10])


def test_runs_keep_their_own_interface(spark):
    docs = spark.createDataFrame([("x", "go " * 6 + "a b a b a b a b end"), (None, None)], "name string, body string")
    rows = {r["doc_id"]: r for r in periodic_runs.collapse_runs(docs, "name", "body").collect()}
    assert [tuple(x) for x in rows["x"]["runs"]] == [(0, 6, 1), (6, 8, 2)] and rows["x"]["collapsed"] == "go a b end"
    assert (rows["x"]["start"], rows["x"]["length"], rows["x"]["period"]) == (6, 8, 2)
    assert rows[None]["runs"] == [] and rows[None]["start"] is None and rows[None]["collapsed"] == ""


def test_equal_lengths_take_the_smallest_start(spark):
    docs = spark.createDataFrame([(1, "x x x x x x y z z z z z z")], "doc_id long, text string")
    row = periodic_runs.collapse_runs(docs).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (2, 0, 6, 1)


# --- contextual extraction -----------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", " -"))
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, form, least, most in ((2, CARD, 13, 19), (3, PHONE, 9, 15)):
        for m in form.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == 3 or passes_luhn(digits)):
                out.append((kind, *m.span()))
    return out


def graph_spans(texts, rounds=contextual_pii.ROUNDS):
    """Per text the base spans and the added ones, from dictionaries."""
    one, base, occurrences = contextual_pii.ONE, [], []
    for n, text in enumerate(texts):
        spans = base_spans(text)
        base.append(spans)
        words = [m.span() for m in WORD.finditer(text)]
        others = []
        for m in re.finditer(r"[A-Za-z0-9@._%+\x80-\U0010ffff-]+", text):
            if re.search("[0-9@]", m[0]):
                begin, end = m.end() - len(m[0].lstrip("._%+-")), m.start() + len(m[0].rstrip("._%+-"))
                if end - begin >= contextual_pii.SHORTEST and all(b <= begin or a >= end for _, a, b in spans):
                    others.append((-1, begin, end))
        low = lambda a, z: text[a:z].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))  # noqa: E731, B023
        for kind, begin, end in spans + others:
            first = max(k for k, (a, _) in enumerate(words) if a <= begin)
            last = max(k for k, (a, _) in enumerate(words) if a <= end - 1)
            before = [low(words[first][0], begin)] * (words[first][0] < begin) + [low(*w) for w in reversed(words[:first])] + ["", ""]
            after = [low(end, words[last][1])] * (end < words[last][1]) + [low(*w) for w in words[last + 1 :]] + ["", ""]
            own = low(begin, end)
            form = "at" if "@" in own else "mixed" if re.search(r"[a-z\x80-\U0010ffff]", own) else "dotted" if own.count(".") >= 2 else "digits"
            pats = {p for p in (("b", *before[:2], form), ("a", *after[:2], form), ("m", before[0], after[0], form)) if any(p[1:-1])}
            occurrences.append((n, kind, begin, end, own, pats))
    edges = {(p, own, kind) for _, kind, _, _, own, pats in occurrences for p in pats}
    size = Counter(p for p, _, _ in edges)
    edges = {e for e in edges if size[e[0]] >= contextual_pii.SUPPORT}
    of = defaultdict(set)
    for p, own, kind in edges:
        if kind < 0:
            of[own].add(p)
    scores = {own: [0] * 4 for own in of}
    for _ in range(rounds):
        strength = {}
        for p in {e[0] for e in edges}:
            mine = [[one * (kind == k) for k in range(4)] if kind >= 0 else scores[own] for q, own, kind in edges if q == p]
            strength[p] = [sum(m[k] for m in mine) // (size[p] + contextual_pii.DOUBT) for k in range(4)]
        scores = {own: [sum(strength[p][k] for p in pats) // len(pats) for k in range(4)] for own, pats in of.items()}
    added = [[] for _ in texts]
    for n, kind, begin, end, own, pats in occurrences:
        options = [(strength[p][k], -k) for p in pats & strength.keys() for k in range(4)
                   if kind < 0 and strength[p][k] >= contextual_pii.SURE_PATTERN and scores[own][k] >= contextual_pii.SURE_INSTANCE]
        if options:
            added[n].append((-max(options)[1], begin, end))
    return base, added


def listed(spans):
    return ",".join(f"{contextual_pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def pii_rows(rows):
    base, added = graph_spans([r["text"] or "" for r in rows])
    for r, b, a in zip(rows, base, added, strict=True):
        yield (r["doc_id"], *(sum(k == x for x, _, _ in b) for k in range(4)), sha(listed(b).encode()), listed(b + a))


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    parts = ["a", "@", ".", "..", "1", "23", "255", "256", "+", "-", " ", "(", ")", "b.c", "x@y.z", "4111 1111 1111 1111", "é", "_", "%", "1.2.3", "00012"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        data = text.encode()
        assert [(k, len(data[:a].decode()), len(data[:b].decode())) for k, a, b in contextual_pii.seeds(data)] == base_spans(text)


def identifier_texts():
    rng = random.Random(5)
    texts = [f"Ring us at +1 (743) 555-38{i:02} before noon" for i in range(40)] + ["ring us at 555-3999 before noon", "Ring us at 555-3999 before noon", "é call 555-3999 or mail"]
    texts += [f"host {i % 7}.{i}.{rng.randrange(256)}.9: up since" for i in range(12)] + ["host 300.1.1.1: up since", "host 4000.1.2: down"]
    texts += [f"mail=<u{i}@example.com>; ok" for i in range(6)] + ["mail=<someone@localhost>; ok", "order 123456 shipped", "order 99887766 shipped", "", None]
    # instances that are discovered in a known context lend a part of their score to another one
    texts += [f"ring us at 77-{i}4444 before noon" for i in range(8)] + [f"pager number 77-{i}4444 please" for i in range(8)] + ["pager number 66-55555 please"] * 3
    return texts


def test_discovered_identifiers(spark, tmp_path):
    texts = identifier_texts()
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = answers(spark, str(tmp_path), "op12_contextual_pii")
    same(found, list(pii_rows(docs.collect())))
    spans = {r[0]: r[6] for r in found}
    at = texts.index
    assert spans[at("ring us at 555-3999 before noon")] == "phone:11:19" and spans[at("ring us at 77-34444 before noon")] == "phone:11:19"
    assert spans[at("host 300.1.1.1: up since")] == "ip:5:14" and spans[at("mail=<someone@localhost>; ok")] == "email:6:23"
    assert spans[at("order 123456 shipped")] == spans[at("pager number 66-55555 please")] == spans[at("")] == ""


def test_identifiers_of_tables_and_awkward_rows(spark, sf_dir, awkward_dir):
    for folder in (sf_dir, awkward_dir):
        same(answers(spark, folder, "op12_contextual_pii"), list(pii_rows(rows_in(spark, folder))))


def test_long_hostile_texts_take_linear_time():
    for text in (b"1" * 300_000, b"a" * 300_000 + b"@@" * 50_000, b"1.2." * 80_000, b"+1 " * 80_000, b"1 " * 150_000):
        contextual_pii.candidates(text, contextual_pii.seeds(text))


# --- Merkle manifest -----------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    paths, below, current = [[] for _ in leaves], [[i] for i in range(len(leaves))], leaves
    while len(current) > 1:
        above, members = [], []
        for i in range(0, len(current), 2):
            run = current[i : i + 2]
            for k, part in enumerate(below[i : i + 2]):
                for m in part:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h(*run))
            members.append(sum(below[i : i + 2], []))
        current, below = above, members
    return current[0], paths


def manifest_rows(rows):
    groups = defaultdict(list)
    for r in rows:
        values = [r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
        changed = checksum(r["doc_id"]) % 7 == 0 and values[3] is not None
        other = leaf_of([*values[:3], values[3] + 1, values[4]]) if changed else leaf_of(values)
        groups[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(values)), r["doc_id"], other))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        groups[lang].sort()
        trees.append(plain_tree([key[2] for key, _, _ in groups[lang]]))
    root, upper = plain_tree([top for top, _ in trees])
    for lang, (top, paths), above in zip(langs, trees, upper, strict=True):
        for (key, doc_id, other), path in zip(groups[lang], paths, strict=True):
            folded = other
            for left, right in path + above:
                folded = h(left, folded, right)
            yield (doc_id, key[2], top, root, h(*(a + b for a, b in path + above)), folded, folded == root)


@pytest.mark.parametrize("band", [5, 2])
def test_manifest(band, spark, sf_dir, awkward_dir, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "BAND", band)
    for folder in (sf_dir, awkward_dir):
        same(answers(spark, folder, "op13_merkle_manifest"), list(manifest_rows(rows_in(spark, folder))))


def test_manifest_of_one_row_and_nested_intervals(spark):
    docs = spark.createDataFrame([(7, None)], "doc_id long, lang string")
    (row,) = merkle_manifest.prove_rows(docs, ["doc_id", "lang"]).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == leaf_of([7, None]) and row["siblings"] == [] and row["verified"]
    leaves = spark.range(21).select(F.lit("g").alias("group"), F.col("id").alias("rank"), F.lit(21).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    nodes = merkle_manifest.grow(leaves).nodes().collect()
    assert sorted((r["level"], r["low"], r["high"]) for r in nodes) == sorted(
        (k, a, min(a + 2**k, 21) - 1) for k in range(1, 6) for a in range(0, 21, 2**k)
    )
    assert all([(c["low"], c["high"]) for c in r["children"]][0][0] == r["low"] and r["children"][-1]["high"] == r["high"] for r in nodes)


def test_ranks_are_consecutive_in_every_group(spark):
    rows = spark.range(0, 500, 1, 7).select((F.col("id") % 3).cast("string").alias("g"), F.lit(5).alias("k"), (F.col("id") % 40).alias("o"))
    found = merkle_manifest.ranked(rows, "g", ["k", "o"]).collect()
    for g in "012":
        mine = sorted((r for r in found if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
        assert [r["o"] for r in mine] == sorted(r["o"] for r in mine)


def test_checksum_of_missing_ids(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(id_checksum("doc_id")).first()[0] == 0
