"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, exact_dedup, language_id, lm_scoring, media_tiff, mixing, ngram_join, quality, substring_dedup
from tessera.llm.common import Words, blocks, text_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"wort{k % 977}x{k}" for k in range(30_000))
DDL = "doc_id long, text string, lang string, source string, n_chars long, row_id string, h int, size double, bucket string, node string, score string, key string"


def frame(spark, rows):
    """Rows (doc_id, text, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, 0.5, "y", "z", "w", None) for i, t, s in rows], DDL)


def texts(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    out = []
    for k, t in enumerate(base):
        out.append(t)
        words = t.split()
        if k % 3 == 0 and words:  # near copies
            words[rng.randrange(len(words))] = "changed"
            out.append("  ".join(words))
        if k % 4 == 0:  # exact copies but for white space
            out.append(t.replace(" ", "\n"))
        if k % 5 == 0:  # a shared passage
            out.append(t + " " + base[0] + " " + base[7])
    out += [None, "", " \t\n", "one", "one", "one two three", LONG, LONG, "Ünïcödé 漢字 <|im_end|>  x", "é"]
    return out


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(k, t, ("a", "b", None, "a")[k % 4]) for k, t in enumerate(texts())]
    rows += [rows[3], rows[-2], (None, "one", "c"), (None, None, "c")]  # repeated rows, null ids
    return rows


def collect(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def words_of(t, lower=False):
    t = t or ""
    if lower:
        t = t.translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(t)


# ---------------------------------------------------------------- shared arrays


def test_word_arrays():
    ts = [t or "" for t in texts(3)]
    raw, offsets = text_bytes(pa.array(texts(3)))
    got, hashes = [], {}
    for i, j in blocks(offsets, 500):
        w = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            span = slice(w.bounds[k], w.bounds[k + 1])
            mine = [w.raw[a:b].tobytes().decode() for a, b in zip(w.start[span], w.end[span])]
            got.append(mine)
            for x, h in zip(mine, w.hash[span].tolist()):
                assert hashes.setdefault(x, h) == h
    assert got == [words_of(t) for t in ts]
    assert len(set(hashes.values())) == len(hashes)


# ---------------------------------------------------------------- 9 exact dedup


def test_exact_dedup(spark, sample):
    got = exact_dedup.exact_dedup(frame(spark, sample), bucket_entries=3)
    rows = collect(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t, _ in sample:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    assert len(rows) == len(sample)
    kept = {}
    for i, keep, size, k, sha in rows:
        kept[sha] = kept.get(sha, 0) + k
        g = next(g for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == sha)
        assert size == len(g) and keep == min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        assert not k or i == keep
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert max(r["chain"] for r in got.collect()) == 1 and len({r["bucket"] for r in got.collect()}) > 1
    # two bits of hash: buckets cannot split further, chains are long, the result is the same
    short = exact_dedup.exact_dedup(frame(spark, sample), bucket_entries=3, hash_bits=2)
    order = lambda rs: sorted(rs, key=repr)
    assert order(collect(short, "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == order(rows)
    assert max(r["chain"] for r in short.collect()) > 5
    # a directory deeper than 14 bits: buckets of one hash
    hashes = spark.range(1 << 15).selectExpr("id * 3 h").union(spark.range(2).selectExpr("(id << 20) + 5 h")).distinct()
    directory, depth = exact_dedup._directory(hashes, 1)
    assert depth > 14
    names = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "x  y")], "doc_id string, text string")
    assert sorted(collect(exact_dedup.exact_dedup(names), "doc_id", "keep_id", "kept"), key=repr) == [("a", None, False), ("b", None, False), (None, None, True)]
    stay = exact_dedup.drop_duplicates(frame(spark, sample))
    assert stay.columns == DDL.replace("long", "").split()[0:1] + [c.split()[0] for c in DDL.split(", ")][1:]
    assert stay.count() == len(groups)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 4 mixing


def test_mixing(spark, sample):
    mix = mixing.mix_sources(frame(spark, sample), edge_docs=5)
    rows = collect(mix, "source", "size", "source_size", "target", "copies", "taken")
    assert sorted(r[1] for r in rows) == sorted(len(words_of(t)) for _, t, _ in sample)
    assert rows and all(0 <= c <= 2 and taken == c * n for _, n, _, _, c, taken in rows)
    total = sum(r[1] for r in rows)
    by = {}
    for s, n, size, target, _, taken in rows:
        x = by.setdefault(s, [0, 0, target, size, 0])
        x[0], x[1], x[4] = x[0] + n, x[1] + taken, max(x[4], n)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        level = (1.5 * total - sum(2 * by[s][0] for s in capped)) / max(1e-9, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and level * weight[s] > 2 * by[s][0]}
        if not more:
            break
        capped |= more
    for s, (words, taken, target, size, longest) in by.items():
        assert size == words
        assert target == pytest.approx(2 * words if s in capped else level * weight[s])
        assert abs(taken - target) <= longest / 2 + 1e-6
    again = mixing.mix_sources(frame(spark, sample), edge_docs=5)
    key = lambda r: repr(r)
    assert sorted(collect(again, "doc_id", "text_hash", "taken"), key=key) == sorted(collect(mix, "doc_id", "text_hash", "taken"), key=key)
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mix_sources(frame(spark, [(1, None, None), (2, "", "a")])).filter("taken <> 0").count() == 0
    for some in (sample, [(1, "a b c", "s")] * 5 + [(2, "d e", "s")]):
        one = mixing.mix_sources(frame(spark, some))
        assert mixing.apply_mix(frame(spark, some), one).count() == sum(c for (c,) in collect(one, "copies"))


def test_mixing_takes_the_smallest_keys(spark):
    """Brute force: documents by key until the budget is met, after complete epochs; hot source and far-off weights."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(("word", "x" * 400, "12", "a,b")) for _ in range(rng.randint(1, 40))), "hot" if k % 3 else "b") for k in range(900)]
    docs = frame(spark, rows)
    got = mixing.mix_sources(docs, edge_docs=3).collect()
    u = mixing.stable_hash(F.concat_ws("|", F.lit("17"), F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    keys = dict(collect(docs.select("doc_id", (-F.log(u) / mixing.quality_weight(F.col("text"), mixing.word_count(F.col("text")))).alias("k")), "doc_id", "k"))
    for s in ("hot", "b"):
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: keys[r["doc_id"]])
        size, target = mine[0]["source_size"], mine[0]["target"]
        epochs, upto = int(target // size), 0
        for r in mine:
            upto += r["size"]
            assert r["copies"] == epochs + (upto - r["size"] / 2 <= target - epochs * size)


# ---------------------------------------------------------------- 5 n-gram join


def shingles(t):
    w = words_of(t, lower=True)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        names.setdefault(root(k), []).append(i)
    return sorted((i, len(sets[k]), min(names[root(k)])) for k, (i, _) in enumerate(rows))


def test_ngram_components(spark, sample):
    rows = [r for r in sample if r[0] is not None]
    got = sorted(collect(ngram_join.ngram_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id"))
    assert got == components([(i, t) for i, t, _ in rows])
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0
    assert collect(ngram_join.ngram_components(frame(spark, [(None, "a b", None)])), "doc_id", "n_shingles", "component_id") == [(None, 1, None)]


def test_families_of_near_copies(spark, monkeypatch):
    """Large groups: copies of two texts with edits of very different extent, and a frequent passage."""
    monkeypatch.setattr(ngram_join, "RARE", 4)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    rng = random.Random(5)
    rows = []
    passage = " ".join(f"p{k}" for k in range(30))
    for f in range(2):
        original = [f"f{f}w{k}" for k in range(120)]
        for k in range(90):
            w = list(original)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 8, 12, 20))):
                w[rng.randrange(len(w))] = f"e{f}_{k}_{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    for k in range(40):
        rows.append((len(rows), passage + " " + " ".join(f"q{k}_{j}" for j in range(rng.choice((3, 5, 9, 60))))))
    rng.shuffle(rows)
    got = sorted(collect(ngram_join.ngram_components(frame(spark, [(i, t, "s") for i, t in rows])), "doc_id", "n_shingles", "component_id"))
    assert got == components(rows)


def test_signatures_meet_every_partner():
    """Whatever counts as frequent, two sets of the similarity share a signature."""
    rng = np.random.default_rng(2)
    for trial in range(300):
        n = int(rng.integers(3, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        keep = rng.permutation(len(a))[: int(np.ceil(len(a) * rng.uniform(0.8, 1)))]
        b = np.unique(np.concatenate([a[np.sort(keep)], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64) * np.uint64(2)]))
        common = len(np.intersect1d(a, b))
        if common * 100 < 75 * (len(a) + len(b) - common) or np.array_equal(a, b):
            continue
        frequent = np.sort(rng.permutation(a)[: int(len(a) * rng.uniform(0, 1))])
        one, two = ngram_join.signatures(a, frequent), ngram_join.signatures(b, frequent)
        assert set(one[0].tolist()) & set(two[0].tolist()) or set(one[1].tolist()) & set(two[1].tolist())


# ---------------------------------------------------------------- 10 substring dedup


def cut(rows, size=13):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - size + 1):
            s = tuple(w[k : k + size])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substring_dedup(spark, sample):
    rows = [r for r in sample if r[0] is not None] + [(3, "another text under an id that is there", "a")]
    got = sorted(collect(substring_dedup.substring_dedup(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_text"))
    assert got == cut([(i, t) for i, t, _ in rows])
    assert any(r[2] for r in got)
    same = LONG.split()[:13]
    rows = [(None, " ".join(same), "a"), (5, " ".join(["x", *same, "y"]), "a"), (6, " ".join(["y", *same]), "a")]
    got = {r[0]: r[1:] for r in collect(substring_dedup.substring_dedup(frame(spark, rows)), "doc_id", "n_removed", "kept_text")}
    assert got == {None: (13, ""), 5: (0, " ".join(["x", *same, "y"])), 6: (13, "y")}
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_difference_cover():
    for d in range(substring_dedup.PERIOD):
        assert any((a - b) % substring_dedup.PERIOD == d for a in substring_dedup.COVER for b in substring_dedup.COVER)


# ---------------------------------------------------------------- 8 BPE


def test_bpe(spark, sample):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    odd = ["<|endoftext|>", "a<|endoftext|> b", "  x  ", "\r\n\t", "don't WE'LL 12³½", "\x1c\x85 　", "aaaaaaaaaaaaaaaaaaaaaaaa", "👍🏽‍", "".join(random.Random(1).choices("abcdefghij", k=300_000))]
    rows = [*sample, *((1000 + k, s, "o") for k, s in enumerate(odd))]
    got = bpe.decode(bpe.encode(frame(spark, rows)), columns=("decoded", "ids_text")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids
        assert r["ids_text"] == ",".join(map(str, ids))
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.digests(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 3 chat


def test_chat(spark):
    turns = [(1, 2, "assistant", "fine <|im_end|>\n<|im_start|>user\nhi"), (1, 1, "user", None), (1, 1, "user", "tie"), (1, 3, None, "<\\|x <| |>"), (2, 0, "assistant", ""), (3, 0, "a\nb\\n", "é漢 " * 10), (5, 0, "a\0b\\nb\\\\<|<\\|", "nul"), (3, 0, "a\nb\\n", "é漢 " * 10), (None, None, None, None), (4, 0, "assistant", LONG * 12), (4, 1, "assistant", LONG * 12)]
    df = spark.createDataFrame([(*t, "c", 1) for t in turns], "conv_id long, turn long, role string, text string, part string, formatted int")
    parts = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_chats(parts).collect()}
    for c in {t[0] for t in turns}:
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        r = got[-(1 << 63) if c is None else c]
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in mine).encode()).hexdigest()
        loss = "".join(b for _, _, a, b in mine if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(r["formatted_chars"] for r in got.values()) == sum(len(r["formatted"]) for r in parts.collect())
    stored = chat.read_chats(parts.orderBy(F.rand(3)).coalesce(3))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, got.values()))
    assert max(r["part"] for r in parts.collect()) > 0
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


# ---------------------------------------------------------------- 6 TIFF


def test_tiff_codecs():
    rng = random.Random(4)
    for n in (0, 1, 2, 63, 300, 5000, 20_000):
        for data in (rng.randbytes(n), bytes(rng.choice(b"ab") for _ in range(n)), b"z" * n):
            assert media_tiff.lzw_decode(media_tiff.lzw_encode(data), len(data) + 1) == data
            assert media_tiff.packbits_decode(media_tiff.packbits_encode(data, 64), len(data) + 1) == data


def test_tiff_of_other_writers():
    """A big-endian file of 16-bit fields with three samples a pixel, deflate and differencing, written by hand."""
    import struct

    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    packed = [zlib.compress(np.diff(image[y : y + 2], axis=1, prepend=np.uint8(0)).tobytes()) for y in (0, 2, 4)]
    body, places = b"", []
    for p in packed:
        places.append(8 + len(body))
        body += p + b"\0" * (len(p) % 2)
    at = 8 + len(body)
    extra = struct.pack(">3H", 8, 8, 8) + b"\0\0" + struct.pack(">3I", *places) + struct.pack(">3I", *map(len, packed))
    entries = [(256, 3, 1, struct.pack(">HH", 7, 0)), (257, 3, 1, struct.pack(">HH", 5, 0)), (258, 3, 3, struct.pack(">I", at)), (259, 3, 1, struct.pack(">HH", 8, 0)), (273, 4, 3, struct.pack(">I", at + 8)), (277, 3, 1, struct.pack(">HH", 3, 0)), (278, 3, 1, struct.pack(">HH", 2, 0)), (279, 4, 3, struct.pack(">I", at + 20)), (317, 3, 1, struct.pack(">HH", 2, 0))]
    ifd = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", *e[:3]) + e[3] for e in entries) + b"\0\0\0\0"
    data = b"MM\0*" + struct.pack(">I", at + len(extra)) + body + extra + ifd
    assert list(media_tiff.decode_tiff(data)) == [(7, 5, 3, image.tobytes())]


def test_malformed_tiffs():
    """Whatever is cut off or overwritten, reading ends in a ValueError of some kind, soon and in little memory."""
    import struct
    import tracemalloc

    rng = random.Random(6)
    whole = [media_tiff.encode_tiff(rng.randbytes(64) * n) for n in (1, 5, 300, 2000)]
    tracemalloc.start()
    for data in whole:
        for _ in range(400):
            bad = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                bad[rng.randrange(len(bad))] = rng.choice((0, 255, rng.randrange(256)))
            at = len(bad) - rng.choice((0, 0, 1, 40)) if len(bad) > 50 else len(bad)
            try:
                list(media_tiff.decode_tiff(bytes(bad[:at])))
            except (ValueError, struct.error, zlib.error):
                pass
    # sizes of 0 and of billions in every field of the directory
    data = whole[0]
    (at,) = struct.unpack_from("<I", data, 4)
    for k in range(struct.unpack_from("<H", data, at)[0]):
        for value in (0, 1 << 31, (1 << 32) - 1):
            for where in (4, 8):
                bad = bytearray(data)
                struct.pack_into("<I", bad, at + 2 + 12 * k + where, value)
                try:
                    list(media_tiff.decode_tiff(bytes(bad)))
                except (ValueError, struct.error, zlib.error):
                    pass
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_tiff_query(spark, sample):
    """The query's columns against the texts themselves; repeated rows and equal texts have equal values."""
    got = {}
    media = media_tiff.write_tiff(frame(spark, sample).select("doc_id", "text"))
    for r in media_tiff.digests(media).collect():
        assert got.setdefault(r["doc_id"], r) == r or r["doc_id"] is None
    files = {}
    for r in media.collect():
        files.setdefault(r["text"] or "", set()).add(bytes(r["media"]))
    assert all(len(x) == 1 for x in files.values())
    for i, t, _ in sample:
        if i is None:
            continue
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        (file,) = files[t or ""]
        columns = np.frombuffer(payload, np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        feature = f"{int(''.join('01'[int(64 * c > columns.sum())] for c in columns), 2):016x}"
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(file), hashlib.sha256(file).hexdigest(), feature)


def test_tiff_columns(spark, sample):
    media = media_tiff.write_tiff(frame(spark, sample).select("doc_id", "text", "source"))
    pages = media_tiff.read_tiff(media).collect()
    texts_back = {}
    for r in pages:
        assert r["error"] is None and r["width"] * r["height"] == len(r["samples"])
        texts_back.setdefault((r["doc_id"], r["text"]), {})[r["page"]] = r["samples"]
    for (_, t), by_page in texts_back.items():
        raw = (t or "").encode()
        payload = b"".join(bytes(by_page[k]) for k in range(len(by_page)))
        assert payload == raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
    assert max(r["page"] for r in pages) > 1
    broken = spark.createDataFrame([(1, b"II*\0"), (2, b"nothing"), (3, None), (4, bytearray(media_tiff.encode_tiff(b"x" * 64)))], "doc_id long, media binary")
    state = {r["doc_id"]: r["error"] is None for r in media_tiff.read_tiff(broken).collect()}
    assert state == {1: False, 2: False, 4: True}
    assert media_tiff.read_tiff(media.limit(0)).count() == 0


# ---------------------------------------------------------------- 1 quality, 2 language, 7 LM


def test_quality(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = collect(quality.op1_quality_classifier(spark, sf), "doc_id", "held_out", "score", "predicted")
    want = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    assert len(got) == docs.count() and all(0 <= s <= 1 and p == (s >= 0.7) for _, _, s, p in got)
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h, _, _ in got)
    held = [(p, want[i]) for i, h, _, p in got if h and i in want]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    nothing = quality.learn(docs.limit(0), spark.read.parquet(f"{sf}/labels.parquet"))
    odd = frame(spark, [(1, None, None), (2, "", None), (3, LONG, None)])
    assert all(r["score"] == 0.5 for r in quality.classify(odd, nothing).collect())
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert all(0 <= r["score"] <= 1 for r in quality.classify(odd, model).collect())
    assert quality.classify(odd.limit(0), model).count() == 0


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = collect(language_id.op2_language_id(spark, sf), "doc_id", "held_out", "lang_pred", "score")
    held = [(p, want[i]) for i, h, p, _ in got if h]
    assert sum(a == b for a, b in held) / len(held) > 0.95 and all(0 <= s <= 1 for *_, s in got)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = frame(spark, [(1, None, None), (2, "12 .,-", None), (3, "", None), (4, "漢", None), (5, LONG, None)])
    model = language_id.learn(docs)
    pred = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, model).collect()}
    assert [pred[k] for k in (1, 2, 3)] == ["und"] * 3 and pred[4] != "und"
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.learn(docs.limit(0))).collect()} == {"und"}
    # every tree's distributions are proper, in seen and unseen contexts
    for tree in model.trees:
        for context in (0x20202000, 0x65207400, 0xFF01FE00, 0x74686500, 0x20C3A400):
            codes = np.uint32(context) | np.arange(256, dtype=np.uint32)
            assert np.exp2(-tree.lengths(codes)).sum() == pytest.approx(1, abs=1e-6)


def test_language_code_lengths():
    """Code lengths against a plain recursion over dictionaries."""
    import math
    from collections import Counter

    rng = random.Random(11)
    learned = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 60))).encode() for _ in range(40)]
    counts: dict[bytes, Counter] = {}
    for t in learned:
        t = b"   " + t
        for k in range(3, len(t)):
            for order in range(4):
                counts.setdefault(t[k - order : k], Counter())[t[k]] += 1

    def p(context, byte):
        shorter = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        seen = counts.get(context)
        if not seen:
            return shorter(byte)
        total, distinct = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (total + distinct)
        return distinct / (total + distinct) * shorter(byte) / (1 - sum(shorter(b) for b in seen))

    def arrays(ts):
        return np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])])

    code, n = np.unique(language_id._codes(*arrays(learned)), return_counts=True)
    trees = language_id.ContextTrees(["x"], [language_id._tree(code, n.astype(float))])
    asked = [b"", b"abca", "dé b zz".encode(), bytes(range(1, 40))]
    want = [sum(-math.log2(p((b"   " + t)[k : k + 3], t[k])) for k in range(len(t))) for t in asked]
    assert trees.code_lengths(*arrays(asked))[:, 0] == pytest.approx(want)


def test_small_languages_of_one_script(spark):
    """Two rare languages of one script are told apart beside two large ones of another."""
    rng = random.Random(2)
    words = {"ru": "что это был она если только когда время жизнь человек большой который через".split(), "uk": "що це був вона якщо тільки коли час життя людина великий який через її є".split(), "en": "what this was she if only when time life human large which through".split(), "de": "was dies war sie wenn nur als zeit leben mensch gross welche durch".split()}
    rows, k = [], 0
    for lang, size in (("en", 400), ("de", 400), ("ru", 12), ("uk", 12)):
        for _ in range(size):
            rows.append((k, " ".join(rng.choice(words[lang]) for _ in range(12)), lang))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs.filter("doc_id % 2 = 0"))
    got = collect(language_id.identify(docs.filter("doc_id % 2 = 1"), model), "lang", "lang_pred")
    assert all(a == b for a, b in got)


def test_lm_scoring(spark, sample, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 20)
    monkeypatch.setattr(lm_scoring, "PORTION", 125)
    rows = [r for r in sample if r[0] is not None]
    docs = frame(spark, rows)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    got = lm_scoring.score_documents(docs, frame(spark, train)).collect()
    c = Counter(x for _, t, _ in train for x in [*words_of(t, lower=True), None])
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(words_of(t)) + 1, sum(c[x] > 0 for x in [*words_of(t, True), None]), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*words_of(t, True), None])) for i, t, _ in rows)
    have = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    assert all(w[3] == pytest.approx(h[3]) for w, h in zip(want, have))
    assert all(r["train_tokens"] == n and r["score"] <= 0 for r in got)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    same = {}
    for r, (i, t, _) in ((r, next(x for x in rows if x[0] == r["doc_id"])) for r in got):
        assert same.setdefault(t, r["score"]) == pytest.approx(r["score"])
    again = lm_scoring.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).collect()
    order = lambda rs: sorted(rs, key=lambda r: (r["doc_id"], r["n_tokens"], r["score"]))
    assert all(a["score"] == pytest.approx(b["score"]) and a["n_known"] == b["n_known"] for a, b in zip(order(got), order(again)))
    none = lm_scoring.score_documents(docs, frame(spark, [])).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)


def test_mixer_is_a_distribution():
    """Over all values of a byte the probabilities in one context add up to 1."""
    rng = np.random.default_rng(0)
    table = rng.normal(size=lm_scoring._TABLE_START[-1]).astype(np.float16)
    k = lm_scoring.CONTEXTS
    model = lm_scoring.Mixer(table, rng.normal(size=(256, k + 1)).astype(np.float32) / 3, rng.normal(size=(3 ** (k - 2), k + 1)).astype(np.float32) / 3, rng.uniform(0.1, 0.9, (256, lm_scoring.BUCKETS)).astype(np.float32))
    code = (np.uint64(0x656874) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert np.exp2(-model.cost(code)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_contexts_are_counted_exactly(spark, sample, monkeypatch):
    """Every context has counts of its own, whatever their number, and joined sequences score as broadcast ones do."""
    from collections import Counter

    monkeypatch.setattr(lm_scoring, "PORTION", 100)
    rows = frame(spark, [*(r for r in sample if r[0] is not None), (900, "ab\nab abc\tab", None)])
    texts = rows.selectExpr("coalesce(text, '') text")
    owned = lm_scoring.count_sequences(texts.selectExpr("text", "true taught", "true asked"))
    parts = [[np.frombuffer(r[c], t) for c, t in (("code", np.uint64), ("n", np.int64))] for r in owned.collect()]
    assert len(parts) > 1
    owners = Counter(int(k) for code, _ in parts for k in np.unique((code >> np.uint64(8)) & np.uint64(lm_scoring.TWO)))
    assert set(owners.values()) == {1}
    seen, size = Counter(), 0
    for t in (r["text"].encode() for r in texts.collect()):
        code = lm_scoring.gram_codes(*lm_scoring.ended(np.frombuffer(t, np.uint8), np.array([0, len(t)])))
        size += len(t) + 1
        for which, context in enumerate(lm_scoring.contexts(code)):
            seen.update((which, int(c), int(b)) for c, b in zip(context, code & np.uint64(255)))
    pairs = lm_scoring._pair_counts(owned)
    for code, n in parts:
        context = lm_scoring.contexts(code)
        for which, total in enumerate(lm_scoring.Runs(context, code, n.astype(float), pairs).totals(8), 2):
            for c, b, k in zip(context[which], code & np.uint64(255), total):
                assert (which == 5 and c < 256) or seen[which, int(c), int(b)] == k
    assert sum(int(n.sum()) for _, n in parts) == size
    scores = []
    for head in (1 << 20, 50):
        monkeypatch.setattr(lm_scoring, "HEAD_CODES", head)
        scores.append(sorted(collect(lm_scoring.score_documents(rows, rows), "doc_id", "score")))
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-4) for a, b in zip(*scores))


def test_lm_is_taught_by_all_text(spark, monkeypatch):
    """Every bit of the training text teaches weights and map, and rounds of teaching lessen its cost."""
    texts = frame(spark, [(k, LONG[k:], None) for k in range(3)]).select("text")
    size, sums, added = sum(len(LONG) - k + 1 for k in range(3)), [], lm_scoring._added
    assert size > 1_000_000
    monkeypatch.setattr(lm_scoring, "_added", lambda *a: sums.append(added(*a)) or sums[-1])
    lm_scoring.learn(lm_scoring.count_sequences(texts.selectExpr("text", "true taught", "false asked")))
    assert sums[0].sum() >= 8 * size and sums[-1].sum() == 8 * size
    costs = [s[-1] for s in sums[1:-1]]
    assert len(costs) == lm_scoring.ROUNDS and min(costs) < 0.95 * costs[0]
