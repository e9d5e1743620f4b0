"""Each operator against a brute-force version, on a small table and on rows made to be awkward."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from groundwell.llm import exact_dedup, license_scan, packing, pii, quality_rules, queries, sentencepiece_codec, shared, simhash, token_output, toxicity, warc
from groundwell.llm.token_blocks import ByteLevelEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1


def equal_texts(rows):
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    out = []
    for text, keys in groups.items():
        keep = min((k for k in keys if k is not None), default=None)
        out += [(k, keep, len(keys), k == keep, hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    return sorted(out, key=str)


def test_exact_dedup_table(spark, data, documents):
    assert sorted(map(tuple, queries.op1_exact_dedup(spark, data).collect()), key=str) == equal_texts(documents.items())


def test_exact_dedup_odd(odd, odd_texts, none):
    assert sorted(map(tuple, exact_dedup.duplicates(odd).collect()), key=str) == equal_texts(odd_texts)
    assert exact_dedup.duplicates(none).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [1, 3, 4, 6, 7, 8, 9]


def test_shared_identifier_gives_way(spark):
    """Different chunks under one identifier are told apart by their SHA-256."""
    part = "array<struct<h: bigint, digest: binary>>"
    own = spark.createDataFrame([(1, "a", [(5, b"a" * 32), (6, b"c" * 32)]), (2, "b", [(5, b"b" * 32), (6, b"c" * 32)]), (3, "a", [(5, b"a" * 32), (6, b"c" * 32)]), (4, "d", [(6, b"c" * 32)])], f"id long, text_sha256 string, parts {part}")
    found = {r.id: r.recipe for r in exact_dedup.verified(own, spark.createDataFrame([(5,)], "h long")).collect()}
    assert found[1] == found[3] != found[2] and found[4] == [6] and len(found[1]) == 6


def test_chunks_join_to_the_text(spark, documents):
    df = spark.createDataFrame([(t,) for t in documents.values()], "text string")
    assert df.where(F.array_join(exact_dedup.chunks(F.col("text"), 512), "") != F.col("text")).count() == 0
    assert df.where(F.exists(exact_dedup.chunks(F.col("text"), 512), lambda x: F.length(x) > 512)).count() == 0


# 2


def check_packing(rows, texts, tokenizer):
    by_doc = collections.defaultdict(list)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    expected = collections.Counter()
    for key, text in texts:
        expected[key, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    for (key, ids), n in expected.items():
        pieces = [r for r in by_doc[key] if r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])]
        assert sum(r.length for r in pieces) >= n * len(ids)
    assert sum(r.length for r in rows) == sum(n * len(ids) for (_, ids), n in expected.items())
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].tier <= 1024 and at & (at - 1) == 0  # full windows, so no padding
    tokens = collections.Counter()
    for pieces in by_sequence.values():
        tokens[pieces[0].step_group] += 1
    assert max(tokens.values(), default=0) <= 64


def test_packing(spark, data, documents, odd, odd_texts, none, tokenizer):
    check_packing(queries.op2_packing(spark, data).collect(), documents.items(), tokenizer)
    check_packing(packing.pack(odd, BPE).collect(), odd_texts, tokenizer)
    assert packing.pack(none, BPE).count() == 0


def test_packer_fills_gaps_with_whole_short_pieces():
    packer = packing.TierPacker(1024)
    for doc, n in enumerate((900, 100, 24, 600, 400, 24)):
        packer.add(doc, n)
    windows = packer.flush(True)
    assert [tier for tier, _ in windows] == [1024, 1024]
    assert all(start == 0 for _, pieces in windows for _, start, _ in pieces)  # nothing was cut


def test_chunked_encoding_is_exact(tokenizer):
    rng = np.random.default_rng(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "é", " ", "　", ".", "<|endoftext|>", "1", "\t", "☃", "…", "'re", "\r\n", "\x1c", "\x85", "A"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + [None, ""]
    ids, rows = ByteLevelEncoder(BPE).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


# 3


def check_sequences(spark, df, texts, folder, tokenizer):
    manifest = token_output.write_sequences(df, folder, BPE, seq_len=128)
    found = token_output.read_documents(spark, folder, df.schema["doc_id"].dataType, with_ids=True).collect()
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at, expected = 0, []
    for key, text in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((key, at, len(ids), crc(ids), ids))
        at += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    for entry in manifest.collect():
        sequences, _ = token_output.open_sequences(folder, entry.path)
        batches = [sequences.get_batch(k) for k in range(sequences.num_record_batches)]
        assert all(b.column("ids").type == pa.list_(pa.uint16(), 128) for b in batches)
        assert sum(b.column("mask").flatten().true_count for b in batches) == entry.n_tokens


def test_token_files(spark, data, documents, odd, odd_texts, none, tokenizer):
    check_sequences(spark, odd, odd_texts, shared.shared_folder(spark, "t"), tokenizer)
    folder = shared.shared_folder(spark, "t")
    assert token_output.write_sequences(none, folder, BPE).count() == 0
    assert token_output.read_documents(spark, folder, none.schema["doc_id"].dataType).count() == 0
    rows = queries.op3_token_output(spark, data).orderBy("doc_id").collect()
    at = 0
    for r in rows:
        ids = tokenizer.encode(documents[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


# 4


def check_pieces(rows, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = collections.Counter()
    for key, text in texts:
        ids = model.encode(text or "")
        expected[key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows)) == expected


def test_sentencepiece(spark, data, documents, odd, odd_texts, none):
    check_pieces(queries.op4_sentencepiece(spark, data).collect(), documents.items())
    check_pieces(sentencepiece_codec.encode_pieces(odd, PIECES).collect(), odd_texts)
    assert sentencepiece_codec.encode_pieces(none, PIECES).count() == 0


def test_marked_words_are_exact():
    encoder = sentencepiece_codec.PieceEncoder(PIECES)
    assert encoder.cuttable
    rng = np.random.default_rng(2)
    parts = ["a", "b", " ", "  ", "\n", "word", "▁", "é", "　", ".", "<s>", "1", "\t", "☃", "Á", "\x00", "ﬁ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + [None, "", " ", "  "]
    for text, ids, back in zip(texts, *(encoder.encode(pa.array(texts))[k] for k in (0, 2)), strict=True):
        assert ids.tolist() == encoder.model.encode(text or "") and back.decode() == encoder.model.decode(ids.tolist())


# 5


def test_toxicity(spark, odd, none):
    data = "/root/testdata/sf0.01"
    rows = queries.op5_toxicity(spark, data).toPandas().merge(pq.read_table(f"{data}/labels.parquet").to_pandas(), on="doc_id")
    held = rows[rows.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93 and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in zip(rows.doc_id, rows.held_out, strict=True))
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, empty)
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.5}
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0


def plain_grams(word, dims):
    """Hashed n-grams of 2 to 5 characters, by plain arithmetic."""
    text, mask = [ord(c) + 1 for c in f" {word} "], (1 << 64) - 1
    for n in (2, 3, 4, 5):
        for k in range(len(text) - n + 1):
            h = 0
            for c in text[k : k + n]:
                h = (h * 0x100000001B3 + c) & mask
            h ^= h >> 29
            h = (h * 0xBF58476D1CE4E5B9) & mask
            yield (h ^ (h >> 32)) % dims


def test_toxicity_by_dictionaries(spark, odd, odd_texts):
    """Features, the optimum of the fit, and scores against plain dictionaries."""
    texts = [(k, f"{'böse wörter 坏话' if k % 3 == 0 else 'gute Worte и слова'} number{k} {'x' * (k % 5)}", int(k % 3 == 0)) for k in range(60)]
    docs, labels = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, dims=512)

    def features(text):
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count = collections.Counter(g for w in words for g in plain_grams(w, 512))
        return {g: n / (len(words) + 40) for g, n in count.items()}

    for row in toxicity.score(docs, model).union(toxicity.score(odd.where("doc_id not in (6, 7, 8)"), model)).collect():
        text = texts[row.doc_id][1] if row.doc_id is not None and row.doc_id < 60 else None
        if text is not None and row.doc_id > 9:
            assert abs(row.score - 1 / (1 + np.exp(-model.bias - sum(model.weights[g] * x for g, x in features(text).items())))) < 1e-5
    seen = [(features(t), y) for k, t, y in texts if zlib.crc32(str(k).encode()) % 5]
    mean = []
    for y in (0, 1):
        own = [f for f, label in seen if label == y]
        total = collections.Counter()
        for f in own:
            total.update(f)
        m = np.array([total[g] / len(own) + 1e-4 for g in range(512)])
        mean.append(m / m.sum())
    ratio = np.log(mean[1] / mean[0])
    x = np.zeros((len(seen), 512))
    for row, (f, _) in enumerate(seen):
        for g, v in f.items():
            x[row, g] = v * ratio[g]
    y, scale = np.array([label for _, label in seen], float), 1 / np.sqrt((x**2).sum() / len(seen))
    w = np.divide(model.weights, ratio * scale, where=ratio != 0, out=np.zeros(512))
    error = 1 / (1 + np.exp(-(x * scale) @ w - model.bias)) - y
    start = abs((x * scale).T @ (0.5 - y)).max() / len(seen)
    assert abs((x * scale).T @ error / len(seen) + 1e-5 * w).max() < 0.02 * start
    assert (((x * scale) @ w + model.bias > 0) == (y == 1)).all()


def test_training_is_bounded(spark, data):
    """No more bytes of features than allowed reach the driver, and null ids are not held out."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    few = toxicity.train(docs, labels, max_bytes=200_000)
    assert not np.array_equal(few.weights, toxicity.train(docs, labels).weights)
    none = toxicity.train(docs, labels, max_bytes=10)
    assert none.bias == 0 and not none.weights.any()


def test_gram_features_count():
    grams, bounds = toxicity.gram_features([b"ab", b"", b"abc"], 1 << 15)
    assert np.diff(bounds).tolist() == [3 + 2 + 1, 1, 4 + 3 + 2 + 1] and bounds[-1] == len(grams)
    words = ["naïve", "坏", "", "😀x"]
    grams, bounds = toxicity.gram_features([w.encode() for w in words], 1 << 15)
    assert [sorted(grams[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [sorted(plain_grams(w, 1 << 15)) for w in words]
    assert len(toxicity.gram_features([b"\xff"], 8)[0]) == 3


# 6


def check_warc(rows, pages):
    groups = collections.defaultdict(list)
    for key, _, html in pages:
        groups[(html or "").encode()].append(key)
    expected = collections.Counter()
    for payload, keys in groups.items():
        last = max((k for k in keys if k is not None), default=None)
        for k in keys:
            revisit = len(payload) >= 1000 and k != last
            expected[k, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", last if revisit else None] += 1
    assert collections.Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected


def test_warc(spark, data):
    big = "é" * 600
    pages = [(1, "http://a/b c\r\nX: y", big), (2, None, big), (2, None, big), (3, "u", "x"), (4, "u", "x"), (5, "", None), (None, "n", big), (None, "n", ""), (7, "z", "y" * 300_000), (6, "z", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, sha1 string, kind int")
    folder = shared.shared_folder(spark, "w")
    manifest = warc.write_warc(df, folder, roll_bytes=400)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(pages) and manifest.count() > 1
    check_warc(warc.read_warc(spark, folder).collect(), pages)
    payloads = {r.id: r.payload for r in warc.read_warc(spark, folder, with_payload=True).collect() if r.record_type == "response"}
    assert payloads[7] == b"y" * 300_000
    folder = shared.shared_folder(spark, "w")
    assert warc.write_warc(df.limit(0), folder).count() == 0 and warc.read_warc(spark, folder).count() == 0
    rows = queries.op6_warc(spark, data).withColumnRenamed("page_id", "id").collect()
    check_warc(rows, [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{data}/pages.parquet").to_pylist()])


def test_warc_of_text_ids(spark):
    big = "z" * 2000
    pages = [("a/b c", "u", big), ("", "u", big), (None, "u", big), ("é%", "u", "x"), ("zz", "u", big)]
    df = spark.createDataFrame(pages, "page_id string, url string, html string")
    folder = shared.shared_folder(spark, "w")
    warc.write_warc(df, folder)
    check_warc(warc.read_warc(spark, folder, id_type="string").collect(), pages)


def test_warc_bytes_do_not_depend_on_the_run(spark):
    import pyarrow.fs as pafs

    df = spark.createDataFrame([(k, f"u{k}", "text " * k) for k in range(50)], "page_id long, url string, html string")
    seen = []
    for _ in range(2):
        folder = shared.shared_folder(spark, "w")
        names = sorted(r.path for r in warc.write_warc(df, folder).collect())
        fs, root = pafs.FileSystem.from_uri(folder)
        seen.append([(n, fs.open_input_file(f"{root}/warc/{n}").read()) for n in names])
    assert seen[0] == seen[1]


# 7


def license_base(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), words


def license_labels(words, threshold):
    """Every window of every template, twice its length, without filters."""
    best, labels = 0.0, set()
    for label, template in license_scan.TEMPLATES:
        inside = license_base(template)[-1]
        for start in range(0, max(len(words), 1), len(inside)):
            share = len(set(inside) & set(words[start : start + 2 * len(inside)])) / len(set(inside))
            if share >= threshold - 1e-9:
                labels.add(label)
                best = max(best, share)
    return labels, best


def check_licenses(rows, texts, threshold):
    found = collections.Counter()
    for r in rows:
        found[(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))] += 1
    expected = collections.Counter()
    for key, text in texts:
        *base, words = license_base(text)
        labels, best = license_labels(words, threshold)
        own = set(base[4].split(",")) - {""} | labels
        expected[(key, *base, ",".join(sorted(own)), 1.0 if base[1] else round(best, 9))] += 1
    assert found == expected


def test_license_scan(spark, data, documents, odd, odd_texts, none):
    check_licenses(queries.op7_license_scan(spark, data).collect(), documents.items(), 0.9)
    check_licenses(license_scan.scan(odd).collect(), odd_texts, 0.9)
    assert license_scan.scan(none).count() == 0
    notice = license_scan.TEMPLATES[1][1].replace("granted", "given").upper()
    texts = [(1, "x " * 50 + notice + " y"), (2, notice[:60]), (3, "MIT\nlicense")]
    check_licenses(license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), threshold=0.85).collect(), texts, 0.85)


def test_notices_with_edits_at_the_threshold(spark):
    """Each notice is found with as many words changed as the threshold allows, wherever it stands, and not with one more."""
    rng, texts, allowed = np.random.default_rng(6), [], []
    for label, template in license_scan.TEMPLATES:
        words = license_base(template)[-1]
        distinct = list(dict.fromkeys(words))
        spare = len(distinct) - int(np.ceil(0.9 * len(distinct) - 1e-9))
        for gone in (spare, spare + 1):
            lost = set(rng.choice(distinct, gone, replace=False).tolist())
            before = [f"u{k}" for k in range(int(rng.integers(0, 300)))]
            texts.append((len(texts), " ".join(before + [f"q{k}" if w in lost else w.upper() for k, w in enumerate(words)] + before[:50])))
            allowed.append((label, gone == spare))
    rows = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_licenses(rows, texts, 0.9)
    for r in rows:
        label, whole = allowed[r.doc_id]
        assert not whole or label in r.labels.split(",")


# 8

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def base_pii(text):
    spans, counts = [], []
    for kind, pattern in PATTERNS.items():
        own = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            own.append(f"{kind}:{m.start()}:{m.end()}")
        spans += own
        counts.append(len(own))
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def test_pii(spark, data, documents, odd, none):
    rng = np.random.default_rng(3)
    parts = ["a", "b@", "c.d", "_", "1", "2.3", ".4.", "+", "99 88 77 66 ", "4", "-", "(", "é", "😀", " ", "+12345 67890", "x@y.z", "\n", "123.45.6.7", "4444333322221111", "%"]
    texts = [(k, "".join(rng.choice(parts, rng.integers(0, 14)))) for k in range(400)] + [(400, None), (401, ""), (402, "1.2.3.4 " * 300)]
    for row in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert tuple(row)[1:6] == base_pii(texts[row.doc_id][1])
    for row in queries.op8_pii(spark, data).collect():
        assert tuple(row)[1:6] == base_pii(documents[row.doc_id])
        secrets = [x for x in row.spans.split(",") if x.startswith("secret")]
        assert len(secrets) == len(re.findall(r'token = "[0-9a-f]{40}"', documents[row.doc_id] or ""))
    long = spark.createDataFrame([(1, "a" * 100_000 + "@"), (2, "1" * 100_000 + "."), (3, "a@b" + ".c" * 30_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_email for r in pii.find(long).collect()} == {1: 0, 2: 0, 3: 1}
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0
    redacted = {r.doc_id: r for r in pii.redact(odd).collect()}
    assert redacted[9].text.endswith('<ip> <email> token = "<secret>"') and redacted[1].text is None and redacted[9].label == "l"


# 9


def fingerprint(text, size=3):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    counts = np.zeros(64, int)
    for x in shingles:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        counts += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def linked(fps, radius=3):
    nodes = sorted(set(fps))
    label = {x: x for x in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[root(a)] = root(b)
    return {x: root(x) for x in nodes}


def check_components(rows, texts):
    fps = [fingerprint(t) for _, t in texts]
    roots = linked(fps)
    least = {}
    for (key, _), fp in zip(texts, fps, strict=True):
        if key is not None:
            least[roots[fp]] = min(key, least.get(roots[fp], key))
    expected = collections.Counter((key, f"{fp:016x}", least.get(roots[fp])) for (key, _), fp in zip(texts, fps, strict=True))
    assert collections.Counter(map(tuple, rows)) == expected


def test_simhash(spark, data, documents, odd, odd_texts, none):
    check_components(queries.op9_simhash(spark, data).collect(), list(documents.items()))
    check_components(simhash.components(odd).collect(), odd_texts)
    assert simhash.components(none).count() == 0


def test_links_and_chains(spark):
    """A chain of fingerprints that only neighbours link, small tiles, and a dense group."""
    rng = np.random.default_rng(4)
    fps, x = [], 0
    for k in range(60):
        x ^= 1 << (k % 64)
        fps.append(x)
    centre = int(rng.integers(1 << 62))
    fps += [centre ^ (1 << a) for a in range(40)] + [int(v) for v in rng.integers(1 << 62, size=300)]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    labels = {r.node: r.label for r in simhash.connected(simhash.links(df, tile_size=8)).collect()}
    of = linked(fps)
    groups = collections.defaultdict(set)
    for fp, s in zip(fps, signed, strict=True):
        groups[of[fp]].add(labels.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_copies_go(spark, none):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    base = [list(rng.choice(words, 400)) for _ in range(40)]
    near = [x[:200] + ["changed"] + x[201:] for x in base]
    half = [x[:200] + list(rng.choice(words, 200)) for x in base]
    texts = [(k, " ".join(x)) for k, x in enumerate(base + near + half)] + [(None, " ".join(base[0])), (900, None), (901, "")]
    df = spark.createDataFrame([(k, t, "u") for k, t in texts], "doc_id long, text string, unit string")
    kept = simhash.keep_one(df)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns
    assert set(range(40)) <= ids and not ids & set(range(40, 80)) and set(range(80, 120)) <= ids and {None, 900, 901} <= ids
    assert simhash.keep_one(none).count() == 0


# 10


def rule_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = collections.Counter(windows)
    marked = {k + s for k, x in enumerate(windows) if count[x] >= 2 for s in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        again += bool(re.search(WORD, line)) and line in seen
        seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(marked) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked), failed


def rule_verdict(text):
    n, chars, symbols, again, marked, failed = rule_counts(text)
    text = text or ""
    lines = sum(bool(re.search(WORD, x)) for x in text.split("\n"))
    capitals, small = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    return not (failed or 10 * symbols > n or capitals > small or 2 * again > lines or chars < 2 * n or chars > 20 * n)


def test_quality_rules(spark, data, documents, odd, odd_texts, none):
    for rows, texts in ((queries.op10_quality_rules(spark, data).collect(), documents.items()), (quality_rules.score_rules(odd).collect(), odd_texts)):
        expected = collections.Counter((k, *rule_counts(t), rule_verdict(t)) for k, t in texts)
        assert collections.Counter(map(tuple, rows)) == expected
    assert quality_rules.score_rules(none).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, t in odd_texts if rule_verdict(t))


def test_every_order_gives_the_same_verdict(documents):
    from groundwell.llm.blocks import buffer_of

    texts = quality_rules.Texts(*buffer_of(pa.array(list(documents.values()), pa.string())))
    whole = quality_rules.cascade(texts, quality_rules.RULES).tolist()
    assert quality_rules.cascade(texts, quality_rules.RULES[::-1]).tolist() == whole


def test_counts_in_large_blocks():
    """More distinct words than fit three to a number."""
    ids = np.arange(2_200_000)
    text = " ".join(np.char.mod("%d", ids)) + " 5 6 7 8"
    from groundwell.llm.blocks import buffer_of

    assert quality_rules.Texts(*buffer_of(pa.array([text]))).n_repeat_words[0] == 8


# Pipeline


def test_pipeline_stages(spark, data, documents, tokenizer):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, data), "stage")
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    good = {k for k, t in documents.items() if rule_verdict(t)}
    assert {r.doc_id for r in seen["quality_rules"].collect()} == good
    texts = {k: re.sub(r"[\x20\x09-\x0D]+", " ", documents[k] or "") for k in good}
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    assert {r.doc_id for r in seen["exact_dedup"].collect()} == set(first.values())
    kept = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k in first.values() for w in [re.findall(WORD, documents[k].lower())]}
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b]
    assert all(b not in kept or a not in kept for a, b, s in pairs if s >= 0.8)
    assert all(k in kept or any(s >= 0.65 for a, b, s in pairs if k == b) for k in sets)
    after = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert set(after) == set(kept)
    for k, text in kept.items():
        assert base_pii(after[k])[:4] == (0, 0, 0, 0) and (after[k] == text) == (sum(base_pii(text)[:4]) == 0 and "token = " not in text)
    check_packing(seen["packing"].collect(), after.items(), tokenizer)
