"""Each operator on the smallest tables and on rows made to be awkward, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import bpe_automaton, decontaminate, jaccard, language, pitman_yor, quality, queries, suffix_array, superkmers, token_counts, url_rules, windows
from tapewright.llm.columns import id_remainder
from tapewright.session import cut_lineage, shared_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, cuts string"
PASSAGE = " ".join(f"word{i % 23}x{i}" for i in range(90))
LONG = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta", "Ünïcode", "x" * 40]) for _ in range(30_000))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def awkward_rows():
    texts = [
        None, "", "   \t\n", "...", "one", "One two  three", PASSAGE, PASSAGE, "before " + PASSAGE + "\nafter", PASSAGE.upper(), LONG, "a" * 1000,
        "x y " * 300, "ab " * 400, "line one\nline one\nline one\n", "tail  \n\n  \u00a0 \u2003 end ", "it's 12 o'clock <|endoftext|> \u4f60\u597d 😀",
        " <|endoftext|>  <|endoftext|>", "the of the of the of the of the of the of the of", "é" * 300, "\u0000odd\u0001", PASSAGE[:399],
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", len(t or ""), 0.5, 7, "extra") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[10], (3, PASSAGE, "en", None, None, None, None, None), (None, "before " + PASSAGE, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(found, wanted):
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def tuples(df):
    return [tuple(r) for r in df.collect()]


# --- substring dedup -----------------------------------------------------------------------------------------------


def cut_words(rows, width=50):
    top = 1 << 63
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, top), top if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (top - 1 if i is None else i):
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def cut_bytes(rows, width=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_words_of_repeated_windows(which, request):
    docs = request.getfixturevalue(which)
    same(tuples(superkmers.dedup_words(docs)), cut_words(rows_of(docs)))


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_bytes_of_repeated_strings(which, request):
    docs = request.getfixturevalue(which)
    wanted = []
    for i, n, gone, spans, kept in cut_bytes(rows_of(docs)):
        # a row that occurs twice is two documents, here as there
        wanted.append((i, n, gone, spans, kept))
    found = [(r[0], r[1], r[2], [tuple(s) for s in r[3]], bytes(r[4])) for r in suffix_array.dedup_bytes(docs).collect()]
    same(found, wanted)


@pytest.mark.parametrize("which", ["awkward", "small", "crowd"])
def test_crowded_minimisers_are_counted_by_digest(which, request, spark, monkeypatch):
    monkeypatch.setattr(windows, "CROWD", 20)
    judged = []
    counted = windows._counted
    monkeypatch.setattr(windows, "_counted", lambda *x: judged.append(x) or counted(*x))
    if which == "crowd":
        r = random.Random(9)
        word = lambda: f"w{r.randrange(10**7)}"
        phrase, passage = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(60))
        texts = [" ".join([*(word() for _ in range(60)), phrase, *(word() for _ in range(60))]) for _ in range(60)]
        texts += [f"{word()} {passage} {word()}" for _ in range(40)] + texts[:5]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    else:
        docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    same(tuples(superkmers.dedup_words(docs)), cut_words(rows))
    found = [(r[0], r[1], r[2], [tuple(s) for s in r[3]], bytes(r[4])) for r in suffix_array.dedup_bytes(docs).collect()]
    same(found, cut_bytes(rows))
    assert len(judged) == 2 or which != "crowd"


def test_suffix_array_and_common_prefixes():
    for seed in range(120):
        r = random.Random(seed)
        n, letters, width = r.randint(1, 300), r.choice([1, 2, 4, 200]), r.choice([8, 16, 24])
        data = np.array([r.randrange(letters) for _ in range(n)], np.uint8)
        wanted = np.zeros(n, bool)
        wanted[r.randint(0, n - 1) :] = True
        wanted[max(0, n - width + 1) :] = False
        eights = suffix_array._eights(data, width)
        order = suffix_array.sorted_suffixes(data, wanted, width, eights)
        strings = [data.tobytes()[i : i + width] for i in order]
        assert sorted(order) == list(np.flatnonzero(wanted)) and strings == sorted(strings)
        common = suffix_array.common_prefixes(eights, order, width)
        for a, b, c in zip(strings, strings[1:], common[1:], strict=False):
            assert c == next((k for k in range(width) if a[k] != b[k]), width)


def test_equal_window_hashes_are_compared_word_by_word(monkeypatch):
    monkeypatch.setattr(superkmers, "window_hashes", lambda prefix, width: np.zeros(len(prefix) - width, np.uint64))
    units = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.uint64)
    at, new = superkmers.equal_groups(units, np.arange(7), 3)
    groups = defaultdict(set)
    for i, g in zip(at, np.cumsum(new), strict=True):
        groups[tuple(units[i : i + 3])].add(int(g))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


# --- near duplicates -----------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components(rows, percent=85):
    top = 1 << 63
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for j, s in enumerate(sets):
        common = Counter(i for g in s for i in lists[g])
        for i, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[i]) - k):
                root[find(j)] = find(i)
        for g in s:
            lists[g].append(j)
    least = defaultdict(lambda: top)
    for j, (i, _) in enumerate(rows):
        least[find(j)] = min(least[find(j)], top if i is None else i)
    back = lambda x: None if x == top else x
    return [(i, len(s), back(least[find(j)]) if s else i) for j, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_jaccard_components(which, request):
    docs = request.getfixturevalue(which)
    same(tuples(jaccard.component_ids(docs)), components(rows_of(docs)))


def test_jaccard_group_longer_than_its_leaders(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(160)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in r.sample(range(160), r.choice([0, 2, 3, 4, 5])):
            own[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(tuples(jaccard.component_ids(docs)), components(rows))


def test_only_texts_of_possible_pairs_travel(spark, monkeypatch):
    r = random.Random(9)
    other = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(["one", "rare", "shared", "phrase", *other(60 + 5 * i)])) for i in range(40)]
    near = other(80)
    rows += [(50, " ".join(near)), (51, " ".join([*near[:-1], "changed"])), (None, " ".join(near)), (None, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    read, stored = jaccard._marked, []
    seen = spark.sparkContext.accumulator(0)

    def counted(shared):
        def run(batches):
            for batch in read(shared)(batches):
                seen.add(batch.num_rows)
                yield batch

        return run

    def store(df, purpose):
        stored.append(df.columns)
        return cut_lineage(df, purpose)

    monkeypatch.setattr(jaccard, "_marked", counted)
    monkeypatch.setattr(jaccard, "cut_lineage", store)
    same(tuples(jaccard.component_ids(docs)), components(rows))
    assert 2 <= seen.value <= 4
    assert not any("text" in columns for columns in stored)


# --- tokens --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_tokens_and_round_trip(which, request, spark):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    library = Tokenizer.from_file(TOKENIZER)
    rows = rows_of(docs)
    coded = library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    wanted = [(i, e.ids, library.decode(e.ids, skip_special_tokens=False)) for (i, _), e in zip(rows, coded, strict=True)]
    found = bpe_automaton.decode_documents(bpe_automaton.encode_documents(docs, TOKENIZER), TOKENIZER)
    same(tuples(found), wanted)
    cache = shared_folder(spark, "test-counts")
    counts = [(i, len((t or "").encode()), len(e.ids), len(e.ids) > 512) for (i, t), e in zip(rows, coded, strict=True)]
    same(tuples(token_counts.count_tokens(docs, TOKENIZER, cache)), counts)
    stored = spark.read.parquet(cache).count()
    same(tuples(token_counts.count_tokens(docs, TOKENIZER, cache)), counts)
    assert spark.read.parquet(cache).count() == stored == len({t or "" for _, t in rows})


def test_automaton_on_random_words():
    from tokenizers import Tokenizer

    library, (machine, _) = Tokenizer.from_file(TOKENIZER), bpe_automaton.automaton(TOKENIZER)
    r = random.Random(3)
    words = ["".join(r.choice("aabcdeeehilnorst-.,'19 éß\n") for _ in range(r.randint(1, 40))) for _ in range(3000)] + ["a" * n for n in range(1, 300, 7)]
    for word, e in zip(words, library.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(machine.encode_text(word, {}), np.int32).tolist() == e.ids


# --- language and model scores ---------------------------------------------------------------------------------------


def test_language_of_held_out_documents(small):
    held = id_remainder("doc_id", 5) == 0
    model = language.train(small.where(~held))
    found = language.identify(small.where(held), model, carry=("lang",)).toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.98 and found.score.between(0, 1).all()


def test_copies_and_long_texts_leave_the_sample_full(spark):
    r = random.Random(6)
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    rows = [("copied", text("abc ", 1000))] * 400 + [("copied", text("abc ", 1000)) for _ in range(20)]
    rows += [("long", text("äöü ", 5000)) for _ in range(30)] + [("mixed", text("xyz ", 5000)), ("mixed", text("xyz ", 900))]
    rows += [("short", text("mno ", 500)) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    samples = language.labelled_sample(docs, 20_000)
    size = {k: sum(map(len, v)) for k, v in samples.items()}
    assert size["copied"] >= 19_000 and len(set(samples["copied"])) == len(samples["copied"])  # 21 distinct texts of 1000 bytes
    assert 19_999 <= size["long"] <= 20_000 and size["mixed"] == 5900 and 10_000 <= size["short"] <= 20_000
    assert all(x.decode() for x in samples["long"])
    few = language.labelled_sample(docs.where("lang = 'copied'").limit(400), 20_000)
    assert few["copied"]


def test_code_lengths_follow_the_definition():
    r = random.Random(2)
    samples = {x: ["".join(r.choice(letters) for _ in range(200)).encode() for _ in range(3)] for x, letters in (("a", "abc "), ("b", "bcde"))}
    trees = language.ContextTrees(samples, order=3)

    def bits(text, name):
        total = 0.0
        for k, byte in enumerate(text):
            for order in range(min(3, k), -1, -1):
                context = text[k - order : k]
                after = Counter(s[j + order] for s in samples[name] for j in range(len(s) - order) if s[j : j + order] == context)
                n, t = sum(after.values()), len(after)
                if after[byte]:
                    total -= math.log2(after[byte] / (n + t))
                    break
                total -= math.log2(t / (n + t)) if n else 0.0
                total += 8.0 if order == 0 else 0.0
        return total

    texts = [b"abca bcd", b"", b"zz", b"eeeddd", samples["a"][0][:50]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = trees.code_lengths(np.frombuffer(b"".join(texts), np.uint8), offsets)
    wanted = [[bits(t, x) for x in trees.languages] for t in texts]
    assert np.allclose(found, wanted, rtol=1e-4, atol=1e-3)


def test_language_of_awkward_rows(awkward, empty):
    found = language.identify(awkward, language.train(awkward)).collect()
    texts = rows_of(awkward)
    assert len(found) == len(texts)
    none = sum(not any(c.isalpha() for c in t or "") for _, t in texts)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in found) == none
    assert {r["lang_pred"] for r in language.identify(awkward, language.train(empty)).collect()} == {"und"}


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_base_scores_and_gain(which, request):
    docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = [[*WORD.findall((t or "").translate(ASCII)), None] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, words, strict=True) if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    found = pitman_yor.score_documents(docs, id_remainder("doc_id", 5) == 1, chunk_tokens=20_000).toPandas()
    wanted = sorted(
        (-1 if i is None else i, held(i), len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4))
        for (i, _), ws in zip(rows, words, strict=True)
    )
    got = sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found.itertuples())
    assert got == wanted
    assert (found.score <= 1e-6).all() and np.isfinite(found.score).all()
    if which == "small":
        assert found[found.held_out].score.sum() > found[found.held_out].base_score.sum()


def test_probabilities_of_a_context_sum_to_one():
    r = np.random.default_rng(1)
    words, names = (np.sort(r.integers(0, 2**63, n).astype(np.uint64)) for n in (40, 3))
    word, context = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(3), indexing="ij"))
    count = r.integers(0, 30, len(word)) * (r.random(len(word)) < 0.4)
    count[word == 7] = 0  # never seen in training
    count[5] = 20_000
    cells = pitman_yor.Cells(words, word, context, count, names)
    known = int((np.bincount(word, weights=count) > 0).sum())
    model = pitman_yor.Model(int(count.sum()), known, cells.per_context(count), 0.7, 0.4, (cells.per_context(count > 0),))
    for _ in range(3):
        tables = list(pitman_yor.seatings(cells, model))[-1][0]
        assert ((tables <= count) & ((tables > 0) == (count > 0))).all()
        model = model._replace(tables=(*model.tables, cells.per_context(tables)))
    scores, counts = pitman_yor.predictive(cells, model)
    assert counts.tolist() == np.bincount(word, weights=count).tolist()
    for c in range(3):
        seen = np.bincount(word, weights=count) > 0
        total = (10 ** scores[context == c])[seen].sum() + 10 ** scores[(context == c) & (word == 7)][0]
        assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("discount", [0.05, 0.3, 0.5, 0.71, 0.95])
def test_seatings_of_many_customers(discount):
    row = np.array([-np.inf, 0.0])
    for c in range(1, 3000):
        t = np.arange(1, c + 2)
        row = np.append(row, -np.inf)
        row[1:] = np.logaddexp(row[:-1], row[1:] + np.log(np.maximum(c - discount * t, 1e-300)))
        if c + 1 in (1500, 3000):
            t = np.arange(1, c + 2)
            found = pitman_yor.log_stirling_at(np.full(len(t), c + 1), t, discount)
            gap = found - row[1:]
            gap -= gap[0]
            # a ratio of neighbours decides between numbers of tables
            assert np.abs(np.diff(gap))[: c // 2].max() < 0.02, (discount, c, np.abs(np.diff(gap))[: c // 2].argmax())
            for weight in (0.5, 5, 50, 500):
                p, q = (np.exp(x - x.max()) for x in (row[1:] + t * math.log(weight), found + t * math.log(weight)))
                assert np.abs(p / p.sum() - q / q.sum()).sum() / 2 < 0.01, (discount, c, weight)


def test_step_as_all_seatings_say():
    d, d0, theta, c, (in_context, of_word, parent) = 0.6, 0.3, pitman_yor.CONCENTRATION, 6, (4, 2, 30)
    wanted = np.zeros(c + 1)

    def seat(sizes: list[int], chance: float) -> None:
        if sum(sizes) == c:
            wanted[len(sizes)] += chance
            return
        for k, n in enumerate(sizes):
            seat([*sizes[:k], n + 1, *sizes[k + 1 :]], chance * (n - d))
        k = len(sizes)
        seat([*sizes, 1], chance * (theta + d * (in_context + k)) * (of_word + k - d0) / (theta + parent + k) if k else 1.0)

    seat([], 1.0)
    n = 20_000
    others = pitman_yor.Others(*(np.full(n, float(x)) for x in (in_context, of_word, parent)))
    tables = pitman_yor.reseat(np.full(n, c), others, d, d0, (np.arange(n) + 0.5) / n)
    assert np.allclose(np.bincount(tables, minlength=c + 1) / n, wanted / wanted.sum(), atol=1e-4)


def test_tables_as_a_sampler_that_moves_one_customer_at_a_time():
    counts = {(0, 0): 6, (0, 1): 4, (0, 2): 1, (1, 0): 3, (1, 1): 7, (2, 2): 2, (3, 0): 1, (3, 2): 5, (4, 1): 2, (4, 2): 4}
    d, d0, theta = 0.6, 0.4, pitman_yor.CONCENTRATION
    r = random.Random(3)
    seats = {k: [c] for k, c in counts.items()}
    sums, rounds = Counter(), 6000
    for turn in range(rounds + 200):
        for (w, x), tables in seats.items():
            for _ in range(counts[w, x]):
                own = r.choices(range(len(tables)), tables)[0]
                tables[own] -= 1
                if not tables[own]:
                    del tables[own]
                in_context = sum(len(t) for (_, y), t in seats.items() if y == x)
                of_word = sum(len(t) for (v, _), t in seats.items() if v == w)
                parent = sum(map(len, seats.values()))
                new = (theta + d * in_context) * (of_word - d0) / (theta + parent) if tables else 1.0
                at = r.choices(range(len(tables) + 1), [*(n - d for n in tables), new])[0]
                if at == len(tables):
                    tables.append(0)
                tables[at] += 1
        if turn >= 200:
            sums.update({k: len(t) for k, t in seats.items()})
    word, context = np.array(sorted(counts)).T
    count = np.array([counts[k] for k in sorted(counts)])
    cells = pitman_yor.Cells(np.arange(5, dtype=np.uint64), word, context, count, np.arange(3, dtype=np.uint64))
    wanted = np.array([sums[k] for k in sorted(counts)]) / rounds

    def mean_tables(one_by_one: bool) -> np.ndarray:
        tables, found = (count > 0).astype(np.int64), np.zeros(len(count))
        for turn in range(rounds + 200):
            chances = pitman_yor._chances(cells, turn)
            for at in [[k] for k in range(len(count))] if one_by_one else [slice(None)]:
                at_parent, known = cells.at_parent(tables), cells.per_context(tables)
                others = pitman_yor.Others(known[context] - tables, at_parent[word] - tables, tables.sum() - tables)
                tables[at] = pitman_yor.reseat(count[at], pitman_yor.Others(*(x[at] for x in others)), d, d0, chances[at])
            found += tables * (turn >= 200)
        return found / rounds

    assert np.abs(mean_tables(True) - wanted).max() < 0.12
    assert np.abs(mean_tables(False) - wanted).max() < 0.12  # steps that see the sweep before


def test_scores_do_not_depend_on_partitions(small, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (2, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = pitman_yor.score_documents(small.repartition(n // 2), id_remainder("doc_id", 5) == 1, chunk_tokens=15_000, bucket_tokens=5_000).collect()
            found.append({r["doc_id"]: r["score"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(abs(x - found[1][i]) < 1e-6 * abs(x) for i, x in found[0].items())


def test_contexts_do_not_share_restaurants(spark):
    docs = spark.range(15_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("before"), F.col("id") % 1500, F.lit(" after"), F.col("id") % 1500).alias("text"))
    found = pitman_yor.score_documents(docs.repartition(3), id_remainder("doc_id", 5) == 1, chunk_tokens=10_000)
    # the first word is one of 1500 (log10: -3.18), the others follow from it
    assert found.where("held_out").agg(F.avg("score")).first()[0] > -3.4


def test_scores_of_buckets_that_exchange_totals(small):
    rows = rows_of(small)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows])
    tokens, begins, bounds = pitman_yor.tokens_of(pa.array([t for _, t in rows]))
    before = np.where(begins, pitman_yor.START, np.append(pitman_yor.START, tokens[:-1]))
    known = np.unique(np.append(tokens, pitman_yor.START))
    part = known >> np.uint64(62)
    named = (part << np.uint64(62)) | (np.arange(len(known)) - np.searchsorted(part, part)).astype(np.uint64)
    tokens, before = (named[np.searchsorted(known, x)] for x in (tokens, before))
    (words, w), (names, c) = (np.unique(x, return_inverse=True) for x in (tokens, before))
    key, index = np.unique(w * len(names) + c, return_inverse=True)
    word, context = np.divmod(key, len(names))
    count = np.bincount(index, weights=np.repeat(~held, np.diff(bounds))).astype(np.int64)
    cells = pitman_yor.Cells(words, word, context, count, names)  # one bucket instead of four
    at_parent = np.bincount(word[count > 0], minlength=len(words))
    share = lambda x: min(0.95, max(0.05, (x == 1).sum() / max(1, (x == 1).sum() + 2 * (x == 2).sum())))
    model = pitman_yor.Model(int(count.sum()), int((at_parent > 0).sum()), cells.per_context(count), share(count), share(at_parent), (cells.per_context(count > 0),))
    for _ in range(pitman_yor.SWEEPS):
        model = model._replace(tables=(*model.tables, cells.per_context(list(pitman_yor.seatings(cells, model))[-1][0])))
    score = pitman_yor.predictive(cells, model)[0]
    wanted = dict(zip((i for i, _ in rows), np.add.reduceat(score[index], bounds[:-1]), strict=True))
    rows = pitman_yor.score_documents(small, id_remainder("doc_id", 5) == 1, chunk_tokens=20_000, bucket_tokens=int(len(tokens) / 2.5)).collect()
    found = {r["doc_id"]: r["score"] for r in rows}
    assert found.keys() == wanted.keys() and np.allclose([found[i] for i in wanted], list(wanted.values()), rtol=1e-5)


def test_scores_without_training_documents(small):
    found = pitman_yor.score_documents(small.limit(5), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and abs(r["score"]) < 1e-9 and abs(r["base_score"]) < 1e-9 for r in found)


# --- decontamination -------------------------------------------------------------------------------------------------


def test_wand_returns_all_above_threshold(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index, r = decontaminate.BlockMaxIndex(items), random.Random(4)
    for _ in range(200):
        terms = sorted(r.sample(range(len(index.terms)), r.choice([5, 40, 200])))
        threshold, scores = r.choice([0.05, 0.2, 0.6]), Counter()
        for t in terms:
            for segment, weight in zip(index.docs[t], index.weights[t], strict=True):
                scores[segment] += weight
        blocks = index.promising(np.zeros(len(terms), np.int64), np.array(terms), threshold)[1]
        found = sorted(s for b in blocks.tolist() for s, _ in index.search(terms, threshold, b))
        assert found == sorted(s for s, x in scores.items() if x >= threshold - 1e-9)


def test_planted_items_are_found(spark, small, sf_dir, awkward, empty):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [(r["item_id"], r["text"]) for r in items.collect()]
    planted = {(d, i) for d, t in rows_of(small) for i, x in texts if x in t}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(small, items).collect()}
    assert planted and planted <= found and len(found) <= len(planted) + 1
    bad = {d for d, _ in found}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(small, items).collect()) == sorted(d for d, _ in rows_of(small) if d not in bad)
    odd = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, "One two three")], "item_id long, text string")
    hits = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(awkward, odd).collect())
    assert hits[6, 1] == 2 and hits[8, 1] == hits[9, 1] == hits[None, 1] == 1 and hits[5, 4] == 1 and not hits[4, 4]
    assert decontaminate.find_leaks(awkward, odd.limit(0)).count() == 0 and decontaminate.without_leaks(empty, odd).count() == 0


def plain_leaks(docs, items):
    """{(doc_id, item_id): (score, question share, answer share)} from every segment against every passage, word by word."""
    words = lambda t: WORD.findall(t.translate(ASCII))
    cut = lambda ws: [list(x) for x in np.array_split(np.array(ws, object), -(-len(ws) // 64))]
    segments = [(i, Counter(part)) for i, (_, text) in enumerate(items) for part in cut(words(text))]
    df, mean = Counter(t for _, s in segments for t in s), sum(s.total() for _, s in segments) / len(segments)
    weighed = []
    for i, s in segments:
        n = s.total()
        w = {t: np.log(1 + (len(segments) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) for t, f in s.items()}
        weighed.append((i, {t: x / sum(w.values()) for t, x in w.items()}))
    grams = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    out = {}
    for doc, text in docs:
        ws, found = words(text or ""), {}
        for k in range(max(1, -(-len(ws) // 64) - 1)):
            passage = set(ws[64 * k : 64 * k + 128])
            for i, w in weighed:
                score = sum(x for t, x in w.items() if t in passage)
                if score >= 0.6 - 1e-9:
                    best, places = found.get(i, (0.0, set()))
                    found[i] = max(best, score), places | {k}
        for i, (score, places) in found.items():
            question, answer = (words(x) for x in decontaminate.split_item(items[i][1]))
            size = min(5, len(question))
            asked = grams(question, size)
            near = {w for k in places for w in ws[max(0, 64 * k - 64) : 64 * k + 128 + 64]}
            shares = len(asked & grams(ws, size)) / len(asked), len(set(answer) & near) / len(set(answer))
            if shares[0] >= 0.8 and shares[1] >= 0.5:
                out[doc, items[i][0]] = (score, *shares)
    return out


@pytest.mark.parametrize("shard", [4_000_000, 1_600])
def test_leaks_equal_every_passage_against_every_segment(spark, small, sf_dir, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    wanted = plain_leaks(rows_of(small), [tuple(r) for r in items.collect()])
    found = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.find_leaks(small, items.union(items)).collect()}
    assert found.keys() == wanted.keys() and wanted
    assert all(np.allclose(found[k], wanted[k], atol=1e-9) for k in wanted)


def test_token_cache_lasts_through_a_session(spark, sf_dir):
    op9 = queries.QUERIES["op9_token_counts"]
    first = sorted(tuples(op9(spark, sf_dir)))
    cache = queries._token_cache(spark, spark.conf.get("spark.checkpoint.dir"), token_counts.tokenizer_version(TOKENIZER))
    rows = lambda: spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count()
    tuples(op9(spark, sf_dir))  # the folder is known from the first call on where the session had none
    held = rows()
    assert sorted(tuples(op9(spark, sf_dir))) == first and held and rows() == held


@pytest.mark.parametrize("answer", [12, 300])
def test_items_of_many_segments_are_found_whole(spark, answer):
    r = random.Random(8)
    sentence = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
    item = " ".join([*(sentence(10) for _ in range((400 - answer) // 10)), sentence(answer)])
    items = spark.createDataFrame([(1, item), (2, sentence(30))], "item_id long, text string")
    # the place of the item moves against the passages; the last document has the question only
    rows = [(i, f"{sentence(17 * i + 1)} {item} {sentence(200)}") for i in range(8)] + [(8, item.rsplit(". ", 1)[0] + ". " + sentence(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_leaks(docs, items).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in found) == [(i, 1) for i in range(8)] and all(x["answer_share"] == 1 for x in found)
    assert [x["doc_id"] for x in decontaminate.without_leaks(docs, items).collect()] == [8]


# --- URL and quality rules -------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://A.Example.NET/en/1?x#y", "http://example.net", "http://net/", "https://x.net?/en/", "http://notexample.com/de/",
            "http://x.example.com/de/1", "http://x.org/fr/", "http://x.org/FR/", "a://b://c.net/", "http://example.net/en"]
    pages = spark.createDataFrame([(i % 9, u, 1) for i, u in enumerate(urls)] + [(None, "http://y.net/z", 2)] * 2, "page_id long, url string, rule int")
    rules = dict.fromkeys(url_rules.RULES)

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(ASCII), m[2]) if m else ("", "")
        best = max(((h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, *best

    wanted = [(r["page_id"], *judge(r["url"])) for r in pages.collect()]
    same(tuples(url_rules.judge_urls(pages, url_rules.rule_table(spark))), wanted)
    none = url_rules.judge_urls(pages, url_rules.rule_table(spark).limit(0))
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "allow")}


@pytest.mark.parametrize("which", ["awkward", "small"])
def test_quality_counts(which, request):
    docs = request.getfixturevalue(which)
    wanted = []
    for i, t in rows_of(docs):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        wanted.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)))
    found = quality.judge_quality(docs)
    same(tuples(found.drop("kept")), wanted)
    assert found.where("base_failed AND kept").count() == 0


def test_empty_tables(spark, empty):
    assert superkmers.dedup_words(empty).count() == suffix_array.dedup_bytes(empty).count() == jaccard.component_ids(empty).count() == 0
    assert bpe_automaton.encode_documents(empty, TOKENIZER).count() == quality.judge_quality(empty).count() == 0
    assert token_counts.count_tokens(empty, TOKENIZER, shared_folder(spark, "test-empty")).count() == 0
    assert pitman_yor.score_documents(empty, id_remainder("doc_id", 5) == 1).count() == 0
    assert language.identify(empty, language.train(empty)).count() == 0


def test_word_bytes_of_sliced_arrow_columns():
    column = pa.array(["zero", None, "one two", ""]).slice(1, 3)
    assert [len(s) for s in jaccard.shingle_sets(column)] == [0, 1, 0]


def test_unlike_texts_with_one_short_hash_and_texts_with_zero_bytes(spark):
    tail = F.concat(F.lit(PASSAGE[:480] + " end"), F.col("id").cast("string"))
    alike = spark.range(300_000).groupBy(F.hash(tail)).agg(F.collect_list(tail).alias("t")).where(F.size("t") > 1).first()["t"]
    letters = "".join(chr(97 + (i * i) % 26) for i in range(200))
    texts = [alike[0] + " x y z", *alike[:2], letters, letters + "\0", "\0" * 250, "\0" * 200 + "a", "b" + letters]
    ids = [0, None, None, 4, 5, 6, 6, None]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(2)
    rows = rows_of(docs)
    same(tuples(superkmers.dedup_words(docs)), cut_words(rows))
    found = [(r[0], r[1], r[2], [tuple(s) for s in r[3]], bytes(r[4])) for r in suffix_array.dedup_bytes(docs).collect()]
    same(found, cut_bytes(rows))
    same(tuples(jaccard.component_ids(docs)), components(rows))
