"""The ten operators against brute force, with hard rows: nulls, empty and very long texts, ties, repeats, clashing names."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import byte_bpe, exact_dedup, feistel_sharding, html_extraction, language_id, packing, pii, quality_rules, simhash, token_counts, word_tokens

random.seed(5)
WORDS = "the of and river stone cloud über straße niño que la ciel tree paper lamp garden mountain quick silver".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (".\n" if r.random() < 0.05 else "") for _ in range(n))


LONG = prose(40_000, 1)
TEXTS = [
    (1, "The river and the stone.  A\tcloud", "en"),
    (2, "The river and the stone. A cloud", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, LONG, "en"),
    (6, LONG.replace(" ", "\n", 3), "en"),
    (7, "x", "de"),
    (7, "x", "de"),
    (8, "  \n\t ", "fr"),
    (9, "日本語 テキスト 😀 it's 12345 \x85\xa0", "fr"),
    (None, "no id here", "fr"),
    (10, prose(300, 2), "es"),
    (11, prose(300, 2) + " end", "es"),
    (12, "a" * 5000, "es"),
    (13, "#%& | | ** junk ** %% $$ ## " * 40, "en"),
    (15, "a <|endoftext|> b<|startoftext|>c <|EndOfText|> <|end oftext|>", "en"),
    (14, prose(60, 3) + " mail me@x.org or +1 (555) 123-4567 from 10.0.0.1 card 4111 1111 1111 1111 end", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, lang, f"src{k % 2}", None if t is None else len(t)) for k, (i, t, lang) in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("norm", "digest", "fp", "part", "_row", "_text", "_words", "n_words", "_id", "_gone", "value", "a.b", "rank"):
        df = df.withColumn(name, F.lit(1))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 1

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def check_packing(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(WORD_FILE)
    want = collections.Counter()
    for i, text, *_ in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], dtype="<u4")
            want[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing(docs, capacity):
    rows = rows_of(packing.pack(docs, WORD_FILE, capacity, keep_ids=True))
    used = check_packing(rows, TEXTS, capacity)
    assert used <= -(-sum(r["length"] for r in rows) // capacity) + 2
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_packing_empty(empty):
    assert packing.pack(empty, WORD_FILE).count() == 0


def test_plan_places_every_piece_once():
    for _ in range(100):
        capacity = random.choice([5, 12, 100])
        histogram = {random.randint(1, capacity): random.randint(1, 30) for _ in range(random.randint(0, 15))}
        seen, room = set(), collections.Counter()
        for s in packing.plan(histogram, capacity):
            for k in range(s.count):
                assert (s.length, s.rank + k) not in seen
                seen.add((s.length, s.rank + k))
                room[s.sequence + k] += s.length
        assert len(seen) == sum(histogram.values()) and max(room.values(), default=0) <= capacity
    with pytest.raises(ValueError):
        packing.plan({7: 1}, 5)


def test_plan_pairs_large_pieces_optimally():
    for _ in range(50):
        sizes = [random.randint(35, 100) for _ in range(12)]
        best, left = 0, sorted(sizes)
        while left:  # largest with the largest that fits is optimal when two fit at most
            x = left.pop()
            mate = [y for y in left if x + y <= 100]
            if mate:
                left.remove(max(mate))
            best += 1
        used = {s.sequence + k for s in packing.plan(collections.Counter(sizes), 100) for k in range(s.count)}
        assert len(used) == best


def test_word_encoder_forgets_and_stays_exact(monkeypatch):
    monkeypatch.setattr(word_tokens, "CACHE_WORDS", 3)
    encoder = word_tokens.WordEncoder(WORD_FILE)
    for text in [prose(50, s) for s in range(10)] + ["ﬁ ẹ́ Σας ΟΔΟΣ İ <|endoftext|> don't, I'm. a.b.c x\x1cy", "w" * 300]:
        assert np.frombuffer(encoder.encode_bytes(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def library_ids(tokenizer, texts):
    return [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def encoded(encoder, texts):
    ids, counts = encoder.encode_all(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, counts.cumsum()[:-1])]


def test_word_encoder_merges_each_small_form_once():
    encoder = word_tokens.WordEncoder(WORD_FILE)
    merged, merges = [], encoder.merges
    encoder.merges = lambda word: merged.append(word) or merges(word)
    texts = ["River, RIVER river. river", "Ñandú ñandú! river$$$ RIVER", "rivers River"]
    got = encoded(encoder, texts[:2]) + [np.frombuffer(encoder.encode_bytes(texts[2]), "<u4").tolist()]
    assert got == library_ids(encoder.tokenizer, texts)
    assert len(merged) == 3 and {"river", "rivers"} < set(merged)


def test_word_encoder_hard_texts(monkeypatch):
    monkeypatch.setattr(word_tokens, "SPREAD", 7)
    encoder = word_tokens.WordEncoder(WORD_FILE)
    letters, r = [chr(i) for i in range(1, 0x260)] + list("\u0300\u0338\u1680\u2003\u3000\u200d日😀ﬁΣⱥẞ١"), random.Random(3)
    parts = ["River", "don't", "'s", "'re", "$$$", "...", "<|endoftext|>", "Straße", "x'", "'t'", "İx", "ȺB", "a1b"]
    texts = ["".join((r.choice(parts) if r.random() < 0.5 else r.choice(letters)) + r.choice(["", "", " ", "\n", "\x0b", "\x0c  "]) for _ in range(r.randint(0, 20))) for _ in range(500)]
    assert encoded(encoder, texts) == library_ids(encoder.tokenizer, texts)
    for k in range(0, 500, 50):
        assert encoded(encoder, texts[k : k + 1]) == library_ids(encoder.tokenizer, texts[k : k + 1])


def test_word_encoder_added_tokens_of_plain_letters_or_with_spaces(tmp_path):
    tokenizer = Tokenizer.from_file(WORD_FILE)
    tokenizer.add_special_tokens(["iv", "<a b>", "!!"])
    tokenizer.save(str(tmp_path / "words.json"))
    encoder = word_tokens.WordEncoder(str(tmp_path / "words.json"))
    for texts in (["the river", "stone"], ["x <a b> y"], ["stone!!! cloud"], ["stone cloud"]):
        assert encoded(encoder, texts) == library_ids(tokenizer, texts)


def test_packing_groups_keep_all_rows(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 10)
    for sizes in ([], [0, 0], [25, 1, 1], [3, 3, 3, 3, 40, 0, 9], [10, 10]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array(["x" * n for n in sizes], pa.string())], names=["doc_id", "text"])
        groups = [g["doc_id"].to_pylist() for g in packing._groups(batch)]
        assert sum(groups, []) == list(range(len(sizes))) and all(groups)
        assert all(sum(sizes[i] for i in g[:-1]) < 10 for g in groups)


def test_packing_ranks_of_more_partitions_than_are_laid_out_together(spark):
    texts = [(i, "a " * (i % 5) if i % 7 else "") for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(300)
    used = check_packing(rows_of(packing.pack(docs, WORD_FILE, 6)), texts, 6)
    assert used == packing_lower(texts)


def packing_lower(texts):
    lengths = [len(text.split()) + 1 for _, text in texts]
    return -(-sum(lengths) // 6)


# 2


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak, few, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 100 if few else 0)
    digest = (lambda c: F.length(c) % 3) if weak else exact_dedup.digest_of
    rows = rows_of(exact_dedup.exact_dedup(docs, digest, salts=3))
    groups = collections.defaultdict(list)
    for i, text, _ in TEXTS:
        groups[norm(text)].append(i)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            want[i, keep, len(ids), False, sha] += 1
        want[keep, keep, len(ids), False, sha] -= 1
        want[keep, keep, len(ids), True, sha] += 1
    want = +want
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows) == want


def test_exact_dedup_keeps_rows(docs, empty):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 5, 7, 8, 9, None, 10, 11, 12, 13, 14, 15]))
    twice = docs.where("doc_id is null").unionByName(docs.where("doc_id is null"))
    assert exact_dedup.drop_copies(twice).count() == 1 and [r.kept for r in exact_dedup.exact_dedup(twice).sort("kept").collect()] == [False, True]
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


# 3


def brute_code_length(texts, text, order):
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        data = t.encode()
        for i in range(len(data)):
            for k in range(order + 1):
                if i >= k:
                    counts[data[i - k : i]][data[i]] += 1
    bits, data = 0.0, text.encode()
    for i in range(len(data)):
        for k in range(min(order, i), -1, -1):
            if found := counts.get(data[i - k : i]):
                total, kinds = sum(found.values()), len(found)
                if data[i] in found:
                    bits += np.log2((total + kinds) / found[data[i]])
                    break
                bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths():
    texts = {"a": [prose(40, 1), "xyz"], "b": ["zzz yyy zzz", "ab"], "c": []}
    for order in (0, 2, 4):
        model = language_id.train(texts, order)
        for text in (prose(30, 7), "q", "", "zzz yyx", "ab"):
            want = [brute_code_length(texts[x], text, order) for x in model.languages]
            assert language_id.code_lengths(model, text) == pytest.approx(want, rel=1e-4)


def test_language_id(spark, docs, empty):
    data = []
    for i in range(400):
        lang = "de" if i % 2 else "en"
        words = "der die und nicht straße über" if i % 2 else "the of and river stone with"
        data.append((i, " ".join(random.Random(i).choices(words.split(), k=20)), lang))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    rows = rows_of(language_id.predict(df, limit=50))
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    rows = rows_of(language_id.predict(docs))
    assert len(rows) == len(TEXTS) and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (3, 4, 8))
    assert language_id.predict(empty).count() == 0
    assert {r["lang_pred"] for r in rows_of(language_id.predict(docs.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


# 4

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_byte_bpe(docs, empty):
    encoding = reference_encoding()
    want = collections.Counter()
    for i, text, _ in TEXTS:
        ids = encoding.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    rows = rows_of(byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert byte_bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_merges_like_the_library():
    encoding, encoder = reference_encoding(), byte_bpe.BytePairEncoder(RANKS, public_tokenizers.PATTERN)
    letters = "ab 's\n\té　\xa0\x1c\x85 1.,'zZ"
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(3000)] + ["ab" * 3000, "a" * 3001, " " * 99 + "x"]
    for text in texts:
        assert encoder.encode(text) == encoding.encode_ordinary(text), repr(text)


def test_decodes_null_and_unknown_ids():
    import pyarrow as pa

    tokens, kind = byte_bpe.vocabulary(RANKS), pa.list_(pa.int32())
    rows = pa.array([None, [], [5, 300, 5], None, [49_999], []], kind)
    want = [b"".join(tokens[i].as_py() for i in row or []) for row in rows.to_pylist()]
    assert byte_bpe.joined(rows, tokens).to_pylist() == want
    assert byte_bpe.joined(rows.slice(2, 3), tokens).to_pylist() == want[2:5]
    assert byte_bpe.joined(pa.array([None, []], kind), tokens).to_pylist() == [b"", b""]
    gap = pa.array([b"a", None], pa.large_binary())
    for unknown in ([1], [2], [-1]):
        with pytest.raises((ValueError, IndexError)):
            byte_bpe.joined(pa.array([unknown], kind), gap)


def test_rank_queue():
    queue, held = byte_bpe.RankQueue(), []
    for _ in range(3000):
        if held and random.random() < 0.5:
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            held.append((random.choice([1, 63, 64, 4096, 50255, 200000]), random.randint(0, 1 << 20)))
            queue.push(*held[-1])
    assert bool(queue.top) == bool(held)


# 5

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0
            if [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else 0, 16 <= len(digits) <= 19 and luhn, 8 <= len(digits) <= 15][kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    for _ in range(6000):
        text = "".join(random.choices("ab@@..-+ 012345(é", k=random.randint(0, 50)))
        assert pii.base_spans(text) == brute_spans(text), text


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_pii_report(docs, empty):
    rows = rows_of(pii.report(docs))
    want = collections.Counter()
    for i, text, _ in TEXTS:
        spans = brute_spans(text or "")
        n = collections.Counter(k for k, _, _ in spans)
        want[i, n[0], n[1], n[2], n[3], hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans)] += 1
    assert collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in rows) == want
    assert pii.report(empty).count() == 0


def test_patterns_find_unseen(spark):
    seeds = [(i, f"please call me on +1 555 010 {i:04d} today") for i in range(20)] + [(100 + i, f"year of {1900 + i} 00 {i:05d} things") for i in range(20)]
    df = spark.createDataFrame([*seeds, (50, "please call me on 555 010 7777 today"), (51, "write it as 555 010 7777 here"), (52, "the number of 555 010 8888 here")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in rows_of(pii.report(df))}
    assert rows[50]["spans"] == "phone:18:30" and rows[50]["n_phone"] == 0 and rows[51]["spans"] == "phone:12:24"
    assert rows[52]["spans"] == "" and all(rows[100 + i]["n_added"] == 0 for i in range(20))


def test_redaction(docs, empty):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS) and pii.redact(empty).count() == 0
    row = out.where("doc_id = 14").first()
    assert row.text.endswith("mail [EMAIL] or [PHONE] from [IP] card [CARD] end") and row.n_chars == len(row.text)
    assert out.where("doc_id = 3").first().text is None
    assert pii.redacted("abcdef", [(0, 1, 3), (3, 2, 5)]) == "a[EMAIL]f"


# 6


def test_token_counts(docs, empty):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(ranks), special_tokens={}).encode_ordinary
    sizes = sorted(len(encode(t or "")) for _, t, _ in TEXTS)
    sums = token_counts.count_tokens(docs, ranks, public_tokenizers.PATTERN)
    rows = {r["n_tokens"]: r for r in rows_of(sums)}
    assert {k: r["n_docs"] for k, r in rows.items()} == collections.Counter(sizes)
    for k, r in rows.items():
        longer = [x for x in sizes if x >= k]
        assert (r["docs_from"], r["tokens_from"], r["total_docs"], r["total_tokens"]) == (len(longer), sum(longer), len(sizes), sum(sizes))
        assert r["truncated_tokens"] == sum(min(x, k) for x in sizes) and r["share_to"] == pytest.approx(np.mean([x <= k for x in sizes]))
    limits = [0, 1, 7, 100, 4096, 10**6]
    assert token_counts.truncated_totals(sums, limits) == {x: sum(min(x, s) for s in sizes) for x in limits}
    got = token_counts.quantiles(sums, [0.0, 0.25, 0.5, 0.99, 1.0])
    assert got == {q: next(s for s in sizes if sum(x <= s for x in sizes) >= q * len(sizes)) for q in got}
    white = docs.limit(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit(" "), 2_000_000).alias("text"))
    assert [r["n_tokens"] for r in rows_of(token_counts.count_tokens(white, ranks, public_tokenizers.PATTERN))] == [len(byte_bpe.BytePairEncoder(ranks, public_tokenizers.PATTERN).encode(" " * 2_000_000))]
    assert token_counts.count_tokens(empty, ranks, public_tokenizers.PATTERN).count() == 0


# 7


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    found = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in found) > len(found))


def test_simhash(spark, docs, empty):
    rows = rows_of(simhash.near_duplicates(docs))
    prints = {}
    for i, text, _ in TEXTS:
        prints.setdefault(text, brute_fingerprint(text))
    parent = {f: f for f in prints.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for i, text, _ in TEXTS:
        root = find(prints[text])
        low[root] = min((x for x in (low.get(root), i) if x is not None), default=None)
    want = collections.Counter((i, f"{prints[t]:016x}", low[find(prints[t])]) for i, t, _ in TEXTS)
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_by_brute_force(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(60)]
    values = {*base, *(x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for x in base for _ in range(4)), *(x ^ 7 << r.randrange(60) for x in base)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in values)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    assert simhash.ball_radii(2, 2) == (1, 0) and simhash.ball_radii(10, 3) == (3, 3, 2) and simhash.ball_radii(1, 3) == (0, 0, -1)
    for radius, segments in ((2, 2), (3, 2), (1, 2), (5, 3), (1, 3), (0, 2)):
        want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        assert {tuple(x) for x in simhash.links(df, radius, segments).collect()} == want


def test_near_copies(spark, docs, empty):
    base = [prose(200, 100 + k).split() for k in range(6)]
    rows, i = [], 0
    for words in base:
        for copy in range(8):
            changed = list(words)
            for j in range(copy % 4):
                changed[(37 * (j + 1) + copy) % 200] = f"new{copy}{j}"
            rows.append((i, " ".join(changed)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    sets = {k: set(" ".join(t.split()[j : j + 5]) for j in range(196)) for k, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert {8 * k for k in range(6)} <= kept and not any(similar(a, b) for a in kept for b in kept if a < b)
    assert all(any(similar(a, b) for b in sets if b < a) for a in set(sets) - kept)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 1 and out.where("doc_id in (2, 6)").count() == 0
    assert simhash.drop_near_copies(empty).count() == 0


# 8


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_quality(docs, empty):
    rows = rows_of(quality_rules.quality(docs))
    want = collections.Counter((i, *brute_quality(t)) for i, t, _ in TEXTS)
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows) == want
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {10, 11, 14} <= kept and 13 not in kept and not any(r["base_failed"] for r in rows if r["kept"])
    good = quality_rules.drop_rejected(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    assert quality_rules.quality(empty).count() == 0 and quality_rules.drop_rejected(empty).count() == 0


def test_repeated_windows(spark):
    r = random.Random(3)
    texts = [(k, " ".join(r.choices("a b c".split(), k=r.randint(0, 80)))) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.doc_id: x.n_repeat_words for x in quality_rules.quality(df).collect()}
    assert got == {k: brute_quality(t)[4] for k, t in texts}


# 9


def test_sharding(docs, empty):
    rows = rows_of(feistel_sharding.shard(docs))
    n = len(TEXTS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in TEXTS)
    assert {r["law"] for r in rows} == {"rows"} and sorted(r["row"] for r in rows) == list(range(n))
    for r in rows:
        place = int(feistel_sharding.permuted(np.array([r["row"]]), n)[0])
        assert (r["shard"], r["slot"]) == (place % 8, place // 8)
        assert feistel_sharding.row_number_at(np.array([r["shard"]]), np.array([r["slot"]]), n)[0] == r["row"]
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = rows_of(feistel_sharding.shard(docs.repartition(7)))
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert feistel_sharding.shard(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096])
def test_permutation(n):
    places = feistel_sharding.permuted(np.arange(n), n)
    assert sorted(places) == list(range(n))
    assert n < 1000 or abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.1


# 10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {0}</a></li></ul></nav>
<!-- c --><div class="ad">Buy {0}</div>{1}<footer>&copy; x {0}</footer>"""


def test_extraction(spark):
    body = "<article><h1>Head {0} &amp; more</h1><p><b>One {0}<br>two&nbsp;x<p>Three &eacute;<div class='comments'><p>Nice {0}</div></article>"
    pages = [(k, f"https://A.example.org/{k}", PAGE.format(k, body.format(k))) for k in range(12)]
    plain = "<div class='page'><div class='text'><p>Unique {0} words {1}</p></div><div class='x7'><p>Read our magazine every week</p></div></div>"
    pages += [(100 + k, f"https://b.example.org:8080/{k}?q", PAGE.format(k, plain.format(k, prose(5, k)))) for k in range(12)]
    pages += [(200, None, "<p>No host"), (201, "https://c.example.org/", None), (None, "odd", ""), (202, "https://c.example.org", "a < b <p>ok</p> &#65; &unknown; <script>x"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("blocks", F.lit(1)).repartition(4)
    out = rows_of(html_extraction.extract(df))
    assert len(out) == len(pages)
    rows = {r["page_id"]: r for r in out}
    for k in range(12):
        assert rows[k]["text"] == f"Head {k} & more\n\nOne {k} two x\n\nThree é" and rows[k]["n_chars"] == len(rows[k]["text"])
        assert rows[100 + k]["text"] == " ".join(f"Unique {k} words {prose(5, k)}".split())
    assert rows[200]["text"] == "No host" and rows[201]["text"] == "" and rows[None]["n_chars"] == 0
    assert rows[202]["text"] == "a < b\n\nok\n\nA &unknown;"
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_parser_holds_up():
    for source in ("<a" * 100_000, "<!--" * 100_000, '<a "' * 100_000, "<div>" * 20_000 + "x", "</p>" * 100_000, "<p" + " a=b" * 50_000 + ">x", "a, " * 200_000, "a- " * 200_000 + "1"):
        html_extraction.parse(source)
    blocks = html_extraction.parse("<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b<ul><li>c</ul></ul>")[0]
    assert [b.text for b in blocks] == ["1", "2", "3", "a", "b", "c"]


def test_references_and_outlines():
    blocks, styles = html_extraction.parse("<body><p>A&<b>lt;</b> x &amp;lt; &eacute;<p><a href=x>Menu one</a> <a>two</a><p>Am 12. May, we - and you - said: <a>so it</a>!</p><div>x</div>")
    assert [b.text for b in blocks] == ["A&lt; x &lt; é", "Menu one two", "Am 12. May, we - and you - said: so it!", "x"]
    assert [b.outline for b in blocks] == ["w&w;w&w;w", "@@", "w0.w:@!", "w"] and blocks[0].home == ">body" and blocks[3].home == ">body>div"
    assert styles[">body"] == ["p:4|p:@|p:6|div"] and html.unescape("&eacute;") == "é"
