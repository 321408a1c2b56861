"""Every training-data operator against a brute-force version, with nulls, empty texts, ties,
repeated rows, empty tables and clashing extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docprep.llm import best_fit, byte_shards, ftrl_langid, id_coding, int8_tiles, lsi_decontam, phrase_automata, pu_toxicity, simhash_bk, warc_index

PHRASE = " ".join(f"w{i}" for i in range(20))
TEXTS = [
    (5, f"start {PHRASE} end"),
    (2, f"other {PHRASE}\tthing  twice"),
    (9, f"start {PHRASE} end"),
    (7, None),
    (1, ""),
    (8, " \n "),
    (3, "Élan É café x y \U0001f600 a  b"),
    (3, "Élan É café x y \U0001f600 a  b"),
    (None, f"none {PHRASE}"),
    (4, "long " + " ".join(str(i * 7919 % 4001) for i in range(5000))),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, shard int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _components(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_brute_force(spark, docs, empty):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefgh"), 60)) for _ in range(30)]
    rows = [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " z") for i, t in enumerate(base)]
    table = docs.select("doc_id", "text", "fp").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")))
    got = simhash_bk.near_duplicates(table, tree_size=8)
    every = sorted(set([r for r in TEXTS if r[0] is not None] + rows), key=lambda r: r[0])

    def fp(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() if False else _words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in every]
    comp = _components(len(every), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    want = {(every[i][0], fps[i], every[comp[i]][0]) for i in range(len(every))}
    rows_ = got.collect()
    assert len(rows_) == len(TEXTS) + len(rows)
    assert {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in rows_ if r.doc_id is not None} == want
    assert all(r.component_id is None for r in rows_ if r.doc_id is None)
    assert simhash_bk.near_duplicates(empty).collect() == []
    kept = [r.doc_id for r in simhash_bk.keep_one_per_group(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for d, _, c in want if d < 100 and c < 100} & {d for d, _, c in want if d == c})


def test_passages_brute_force(spark, docs, empty):
    got = phrase_automata.deduplicated(docs.withColumn("n_words", F.lit("clash")), salt_rows=1, shard_stretches=2).collect()
    assert len(got) == len(TEXTS)
    first = {}
    for d, t in sorted((r for r in TEXTS if r[0] is not None), key=lambda r: r[0]):
        w = _words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for r in got:
        w = _words(r.text)
        gone = set()
        for i in range(len(w) - 12):
            if r.doc_id is not None and first[tuple(w[i : i + 13])] < r.doc_id:
                gone |= set(range(i, i + 13))
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
        assert r.kept_text == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert phrase_automata.deduplicated(empty).collect() == []


def test_patterns_are_whole_windows():
    shard = phrase_automata.Shard(13)
    for doc, words in ((3, PHRASE.split()), (4, ["x"] + PHRASE.split()[2:]), (4, PHRASE.split()[:13]), (9, ["y"] * 20)):
        shard.add(" ".join(words).encode(), doc, 0, 100)
    shard.confirm()
    patterns = shard.patterns()
    assert {len(w) for w in patterns} == {13} and set(patterns.values()) == {3}
    assert sorted(shard.runs()) == [(4, 0, 100, 113), (4, 0, 101, 119)]


@pytest.mark.parametrize("salt_rows", [1, 2, 4096])
def test_hot_passage_over_salts(spark, salt_rows):
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for i in range(40):
        own = [" ".join(rng.choice(list("abcdefg"), 30)) for _ in range(2)]
        at = rng.integers(0, 30)
        texts.append((int(rng.integers(0, 35)), f"{own[0]} {' '.join(passage.split()[at : at + 30])} {own[1]}"))
    got = phrase_automata.deduplicated(spark.createDataFrame(texts, "doc_id long, text string"), salt_rows=salt_rows, shard_stretches=15).collect()
    first = {}
    for d, t in sorted(texts):
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    want = []
    for d, t in texts:
        w = t.split()
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        want.append((d, len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in got) == sorted(want) and sum(n for _, n, _ in want) > 500


def test_shards(docs, empty):
    rows = byte_shards.assign_shards(byte_shards.sized(docs), shards=4, block_rows=3).collect()
    assert len(rows) == len(TEXTS)
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append((r.slot, r.doc_id))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
    order = [d for s in sorted(slots) for _, d in sorted(slots[s])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in TEXTS}
    assert byte_shards.assign_shards(byte_shards.sized(empty)).collect() == []


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 16))
    x = np.concatenate([x, x[:40] + rng.normal(size=(40, 16)) * 0.25, x[:5], x[:3] * 2]).astype(np.float32)
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    odd = [(900, None, "l"), (901, [0.0] * 16, "l"), (902, [float("nan")] * 16, "l"), (903, [None] * 16, "l"), (904, [1.0, 2.0], "l"), (905, [], "l")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in int8_tiles.near_duplicates(table, block=32).collect()}
    n = x.astype(np.float64)
    n /= np.linalg.norm(n, axis=1)[:, None]
    near = n @ n.T >= 0.9
    np.fill_diagonal(near, False)
    comp = _components(len(x), np.argwhere(np.triu(near)).tolist())
    assert near.sum() > 50
    assert got == {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(x))} | {k: (0, k, True) for k, *_ in odd}
    assert int8_tiles.near_duplicates(table.where("false")).collect() == []


def _ids(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_added_tokens_as_the_library(spark):
    """Ids equal those of a plain Tokenizer for texts that hold an added token's string; the other reading is an option."""
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b c\nd", "<|endoftext|>", "x <|ENDOFTEXT|> <|endoftext |>", "plain  text\n\n here", "<|endoftext|>\t<|endoftext|>  z", "hello world", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for special_as_text in (False, True):
        byte, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
        byte.encode_special_tokens = word.encode_special_tokens = special_as_text
        option = {"special_as_text": True} if special_as_text else {}
        rows = best_fit.tokenised_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), **option).collect()
        want = {i: [*byte.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == want
        rows = id_coding.read_corpus(spark, id_coding.write_corpus(docs, public_tokenizers.path("word_bpe_49k.json"), **option)).collect()
        want = {i: [*word.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == want
    assert Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = best_fit.pack(best_fit.tokenised_pieces(docs, path, capacity=64), capacity=64, open_bins=4, group_pieces=20).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for v in sequences.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 64
    for d, t in TEXTS:
        want = np.array(_ids("byte_bpe_50k.json", t, 0), dtype="<u4")
        own = sorted(((r.piece, r.start, bytes(r.ids)) for r in rows if r.doc_id == d))
        own = own[:: sum(x == d for x, _ in TEXTS)]
        assert b"".join(x for *_, x in own) == want.tobytes()
    assert best_fit.pack(best_fit.tokenised_pieces(empty, path)).collect() == []
    with pytest.raises(ValueError):
        best_fit.BestFit(8, 2).put(9)


def test_ids_round_trip(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = id_coding.read_corpus(spark, id_coding.write_corpus(docs, path, segment_ids=50)).collect()
    rows.sort(key=lambda r: r.start)
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in order]
    at = 0
    for r, (_, t) in zip(rows, order):
        want = _ids("word_bpe_49k.json", t, 1)
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(want), np.array(want, dtype="<u4").tobytes())
        at += len(want)
    assert id_coding.read_corpus(spark, id_coding.write_corpus(empty, path)).collect() == []
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], dtype="<u4")
    c, d = id_coding.encode_ranks(ranks)
    assert (id_coding.decode_ranks(np.frombuffer(c, np.uint8), np.frombuffer(d, np.uint8), 7) == ranks).all()


def test_warc_round_trip(spark):
    big = "é" * 800
    rows = [(1, "http://A.example.com/x?q=1#f", big), (4, None, big), (3, "https://u@b.org", big), (2, "b", "small"), (6, "b", "small"), (5, "", None), (None, "http://c.d/", big), (2, "b", "small")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, offset int")
    folder, top = warc_index.archive(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_index.read_back(pages, folder, top).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if h == big and p != 4 else "response", 4 if h == big and p != 4 else None) for p, _, h in rows]
    assert got == sorted(want, key=str)
    assert spark.createDataFrame([("http://A.example.com:80/x?q#f",)], "u string").select(warc_index.url_key(F.col("u"))).first()[0] == "com:80,example,a)/x?q"
    folder, top = warc_index.archive(pages.where("false"))
    assert warc_index.read_back(pages, folder, top).collect() == []


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    common = ["the", "of", "and", "to", "is"]
    text = lambda n: " ".join(rng.choice(vocab if rng.random() < 0.6 else common) for _ in range(n))
    items = [(i, f"{text(20)}. {text(8)}.", "x") for i in range(12)] + [(90, None, "x"), (91, "too short", "x")]
    rows = [(1000 + i, text(150)) for i in range(60)]
    rows += [(i, f"{text(70)} {items[i][1].upper()} {text(70)}") for i in range(6)]
    paraphrase = [w for k, w in enumerate(items[7][1].split()) if k % 7]
    rows += [(7, f"{text(40)} {' '.join(paraphrase)} {text(40)}"), (50, None), (51, "")]
    table = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, item_id string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    found = lsi_decontam.matches(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in [*range(6), 7]}
    left = lsi_decontam.decontaminated(table, bench)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {*range(6), 7}
    assert lsi_decontam.matches(empty, bench).collect() == [] and lsi_decontam.matches(table, bench.where("false")).collect() == []
    brute = lambda a, b: len(a) and max(np.diag(_lcs(a, b)).max(), _lcs(a, b)[-1, -1])
    a, b = [1, 2, 3, 4, 2, 1], [2, 9, 3, 1, 2, 4, 1]
    assert lsi_decontam.lcs_length(a, b) == _lcs(a, b)[-1, -1] == brute(a, b)


def test_decontamination_finds_every_copy(spark):
    """Whole copies are found by their runs of words, however little of them the latent space keeps."""
    rng = np.random.default_rng(7)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    items = [(i, " ".join(rng.choice(vocab, 5 + i % 8))) for i in range(120)]
    dashed = lambda t: t.replace(" ", " -- ").title()
    rows = [(i, f"{' '.join(rng.choice(vocab, 90))} {dashed(t) if i % 2 else t} {' '.join(rng.choice(vocab, 90))}") for i, t in items]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = lambda found: {r.doc_id for r in found.collect() if r.doc_id == r.item_id and r.lcs_share == 1}
    assert whole(lsi_decontam.matches(docs, bench, rank=16)) == set(range(120))
    assert whole(lsi_decontam.matches(docs, bench, cosine=1.1, min_words=1)) == set(range(120))
    assert lsi_decontam.decontaminated(docs, bench, rank=16).count() == 0
    short = spark.createDataFrame([(0, vocab[0]), (1, " ".join(vocab[1:4]))], "item_id long, text string")
    text = spark.createDataFrame([(0, f"x {vocab[0]} y"), (1, f"x {' '.join(vocab[1:4])} y")], "doc_id long, text string")
    assert whole(lsi_decontam.matches(text, short, cosine=1.1, min_words=1)) == {0, 1}


def test_term_numbers_and_run_sums():
    raw = "  ¿Qué's the «Fox», fox? x_1 _fox_ don't \u3000 well-known (THE) ... ΣΑΣ fox!!"
    number = {w: k for k, w in enumerate(dict.fromkeys(lsi_decontam.normal_words("the fox don't well-known qué's σας")))}
    got = lsi_decontam._Terms(number)(raw.encode())
    plain = [number.get(lsi_decontam._EDGE.sub("", w), -1) for w in raw.lower().split()]
    assert got.tolist() == plain and plain.count(number["fox"]) == 4
    assert lsi_decontam._Terms(number)(None).tolist() == []
    rng = np.random.default_rng(1)
    keys = np.sort(np.concatenate([rng.integers(0, 40, 200), np.full(500, 7), np.full(64, 50)]))
    rows, pick = rng.standard_normal((30, 5)), rng.integers(0, 30, len(keys))
    out, right = np.zeros((60, 5)), np.zeros((60, 5))
    lsi_decontam._add_runs(out, keys, rows, pick)
    np.add.at(right, keys, rows[pick])
    assert np.allclose(out, right)


def _lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t


def test_toxicity_held_out(spark, empty):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        body = list(rng.choice(words, 40)) + (["vilewordly!", "Nastyish"] if toxic else [])
        rows.append((i, " ".join(rng.permutation(body)), 0.5))
        labels.append((i, int(toxic), "z"))
    rows += [(5000, None, 0.1), (5001, "", 0.1), (None, "word1", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(2)
    table = spark.createDataFrame(labels + [(3, None, "z"), (None, 1, "z")], "doc_id long, toxic int, text string")
    model = pu_toxicity.train(docs, table)
    got = [(r.doc_id, r.score) for r in pu_toxicity.scores(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    held = [(s >= 0.3, d % 8 == 0) for d, s in got if d is not None and d < 1500 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert pu_toxicity.train(docs, table.where("false"))[0] == {}
    assert pu_toxicity.scores(empty, model).collect() == []


def test_language_held_out(spark):
    rng = np.random.default_rng(4)
    parts = {"aa": ["ka", "to", "mi", "ré"], "bb": ["sch", "ung", "ver", "ü"], "cc": ["the", "ing", "wh", "ou"]}
    rows = []
    for i in range(600):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(12)), lang, 0.0))
    rows += [(9000, None, "aa", 0.0), (9001, " 12 -- ", "bb", 0.0), (9002, "kato mire", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = ftrl_langid.train(docs)
    got = {r.doc_id: r for r in ftrl_langid.predict(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [got[i].lang_pred == lang for i, _, lang, _ in rows[:600] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean(held) > 0.98
    assert got[9000].lang_pred == got[9001].lang_pred == "und" and got[9002].lang_pred == "aa"
    assert ftrl_langid.train(docs.where("false")) is None


def test_repeated_ids_count_once_in_the_fits(spark):
    """Repeated rows of sampled ids neither end the fits nor weigh in them."""
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(100)]
    rows = [(i, " ".join([*rng.choice(words, 20), *["vileword"] * (i % 3 == 0)]), "ab"[i % 2]) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema)
    # every row again, and one id very often
    often = docs.unionByName(docs).unionByName(docs.where("doc_id = 3").crossJoin(spark.range(1500).select()))
    small = {"max_positive": 60, "max_unlabelled": 120}
    weights, bias = pu_toxicity.train(docs, labels, **small)
    assert weights and (weights, bias) == pu_toxicity.train(often, labels, **small)
    # languages: the id picked first has many rows of a text that says nothing; the others are still learned from
    tell = docs.select("doc_id", F.when(F.col("lang") == "a", "kato mire").otherwise("schung ver").alias("text"), "lang")
    first = tell.where(ftrl_langid.fold(F.col("doc_id")) != ftrl_langid.HELD_OUT).groupBy("lang").agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id"))
    empty_of = first.select("doc_id", F.lit("qq").alias("text"), "lang").crossJoin(spark.range(70).select())
    mixed = tell.join(first, "doc_id", "left_anti").select("doc_id", "text", "lang").unionByName(empty_of.select("doc_id", "text", "lang"))
    found = ftrl_langid.predict(mixed.where("text <> 'qq'"), ftrl_langid.train(mixed, per_language=50)).collect()
    assert len(found) == 238 and all(r.lang == r.lang_pred for r in found)
    src = mixed.select(F.col("doc_id").alias("id"), F.col("text").alias("t"), "lang")
    sample = ftrl_langid.sample_counts(src, ftrl_langid.pick(src, 50), 1 << 14)
    got = sample.collect()
    assert sample.columns == ["id", "lang", "at", "n"] and len(got) == len({(r.id, r.lang) for r in got}) == 100


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in C.STAGES:
        before, docs = docs, C.materialise(stage(spark, docs, SF), "stage")
        counts.append(docs.count())
        if name != "best-fit packing":
            assert docs.columns == before.columns and counts[-1] <= counts[-2]
    pieces = docs.select("doc_id").distinct().count()
    assert pieces == counts[-2]


def test_pipeline_decisions(spark, tmp_path):
    """Planted toxic texts, near copies, shared passages and benchmark items: ids and texts left after every stage."""
    import corpus_pipeline as C

    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    fresh = lambda n: " ".join(rng.choice(vocab, n))
    base = {i: fresh(60) for i in range(800)}
    toxic = {i: f"{t} vilewordly! Nastyish" for i, t in base.items() if i % 8 == 0}
    base |= toxic
    copies = {2000 + i: base[i].upper() for i in range(1, 200) if i % 8}
    parts = {3000 + i: (fresh(40), " ".join(base[i].split()[10:30]), fresh(40)) for i in range(1, 100) if i % 8}
    items = {i: fresh(30) for i in range(40)}
    holds = {4000 + i: f"{fresh(50)} {t} {fresh(50)}" for i, t in items.items()}
    every = base | copies | {i: "  ".join(p) for i, p in parts.items()} | holds
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(i, t, "en", "s", len(t)) for i, t in every.items()], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([(i, 1, int(i in toxic)) for i in base], "doc_id long, quality int, toxic int", "labels")
    save(list(items.items()), "item_id long, text string", "benchmark")

    clean = {i: t for i, t in every.items() if i not in toxic}
    single = {i: t for i, t in clean.items() if i not in copies}
    cut = single | {i: f"{a} {b}" for i, (a, _, b) in parts.items()}
    want = [clean, single, cut, {i: t for i, t in cut.items() if i not in holds}]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), left in zip(C.STAGES, want):
        docs = C.materialise(stage(spark, docs, str(tmp_path)), "stage")
        got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
        assert docs.count() == len(got) and got == {i: (t, len(t)) for i, t in left.items()}, name
    sizes = collections.Counter()
    for r in C.STAGES[4][1](spark, docs, str(tmp_path)).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(_ids("byte_bpe_50k.json", t, 0)) for i, t in want[3].items()}


def test_lower_cased_letters_have_the_same_ids():
    """The cache holds one stretch for both cases of Latin letters: the library must see them alike."""
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x250) if chr(c).lower() != chr(c)]
    words = [x + y for x in letters for y in ("", "a", "\u0301", ".")]
    plain, lower = (lib.encode_batch(w, add_special_tokens=False) for w in (words, [w.lower() for w in words]))
    assert [e.ids for e in plain] == [e.ids for e in lower]
