import cProfile
import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import gif, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = [None, "", "hello world", "naïve ünïcödé 日本語 🙂\n\n  tabs\tand <|endoftext|> here", "x" * 5000, "word " * 6000, "<|endoftext|> hi", "a<|endoftext|><|endoftext|>b <|endoftext", " <|endoftext|> ", "don't we'll I'm", " \n ", "a b c", "tail  "]


def test_pieces_hold_the_tokenizers_ids(spark, docs):
    rows = packing.pack(docs(*enumerate(TEXTS))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(TEXTS):
        ids = np.array(reference_ids(t), "<u4")
        own = sorted(by[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert all(r["length"] == 2048 for r in own[1:])


def test_sequences_are_gapless_and_full(spark, docs):
    r = random.Random(2)
    rows = packing.pack(docs(*[(i, "token " * r.randint(0, 1500)) for i in range(300)]), group=60).collect()
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    total = sum(x["length"] for x in rows)
    assert len(by) <= 1.04 * total / 2048 + 2


def test_repeated_rows_spread_over_groups(spark, docs):
    rows = packing.pack(spark.range(4000).selectExpr("5L doc_id", "'ab cd ef' text"), group=500).collect()
    assert len(rows) == 4000 and len({x["sequence_id"] >> 24 for x in rows}) > 4


def test_best_two_fit_swaps_the_smallest():
    # Greedy takes 6 then 3 of 10; 2 and 2 fit the gap of 4 that 3 leaves exactly.
    assert sorted(map(sorted, ([[6, 2, 2], [3]]))) == sorted(sorted(np.array([6, 3, 2, 2])[b].tolist()) for b in packing.best_two_fit(np.array([6, 3, 2, 2]), 10))


def test_best_two_fit_packs_everything_once():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 700):
        s = r.integers(1, 2048, n)
        bins = packing.best_two_fit(s)
        assert sorted(sum(bins, [])) == list(range(n)) and all(s[b].sum() <= 2048 for b in bins)


def test_pack_edges(spark, docs, clashing):
    assert packing.pack(docs()).count() == 0
    rows = packing.pack(clashing((1, "a"), (1, "a"), (None, None))).collect()
    assert len(rows) == 3 and len({(x["sequence_id"], x["offset"]) for x in rows}) == 3


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trips(bits):
    r = random.Random(bits)
    for n in (0, 1, 2, 5, 300, 5000, 60000):
        for alphabet in (1, 2, 1 << bits):
            s = bytes(r.randrange(alphabet) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(s, bits), bits, n) == s


def test_lzw_known_stream():
    # The usual 10 x 10 example image of the format's tutorials.
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    want = bytes.fromhex("01010101010202020202") * 3 + bytes.fromhex("01010100000000020202") * 2 + bytes.fromhex("02020200000000010101") * 2 + bytes.fromhex("02020202020101010101") * 3
    assert gif.lzw_decode(stream, 2, 100) == want


def test_damaged_streams_end_quietly():
    good = gif.lzw_encode(os.urandom(3000))
    for cut in (0, 1, 7, 500, len(good) - 1):
        assert len(gif.lzw_decode(good[:cut], 8, 3000)) == 3000
    assert len(gif.lzw_decode(os.urandom(500), 8, 3000)) == 3000


def build(frames, size=(4, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + b"\x81\0\0" + bytes(x for c in palette for x in c)
    for f in frames:
        x, y, w, h, idx, disposal, transparent, delay, interlaced = f
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + delay.to_bytes(2, "little") + bytes([transparent or 0]) + b"\0"
        out += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([64 * interlaced]) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(idx), 2))
    return out + b"\x3b"


def test_disposal_and_transparency():
    base = (0, 0, 4, 2, [1] * 8, 1, None, 5, False)
    spot = lambda disposal: (1, 0, 2, 1, [2, 0], disposal, 0, 7, False)
    last = (0, 1, 1, 1, [3], 0, None, 1, False)
    for disposal, want in ((1, (0, 255, 0, 255)), (2, (0, 0, 0, 0)), (3, (255, 0, 0, 255))):
        f = gif.decode(build([base, spot(disposal), last]))
        assert [x.start_cs for x in f] == [0, 5, 12]
        assert tuple(f[1].pixels[0, 1]) == (0, 255, 0, 255) and tuple(f[1].pixels[0, 2]) == (255, 0, 0, 255)
        assert tuple(f[2].pixels[0, 1]) == want and tuple(f[2].pixels[1, 0]) == (0, 0, 255, 255)
        assert gif.histogram(f[0].pixels)[48] == 8


def test_interlaced_rows():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    idx = [v % 4 for r in rows for v in [r]]
    f = gif.decode(build([(0, 0, 1, 9, idx, 0, None, 0, True)], (1, 9)))
    assert list(f[0].indices) == [r % 4 for r in range(9)]


def test_texts_come_back_from_the_media(spark, docs):
    texts = [None, "", "a", "é" * 500, "x" * 192, "y" * 193, "long text " * 200000]
    from pyspark.sql import functions as F

    d = docs(*enumerate(texts)).withColumn("m", gif.stored.asNondeterministic()("text"))
    for x in d.select("doc_id", "m.*").collect():
        n, payload = gif.payload_of(texts[x["doc_id"]])
        assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == (texts[x["doc_id"]] or "").encode().rstrip(b" ")
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = gif.encode_samples(payload)
        assert b"".join(f.indices for f in gif.decode(media, compose=False)) == payload
        assert x["media_sha256"] == hashlib.sha256(media).hexdigest() and x["media_bytes"] == len(media)


def test_frames_column(spark):
    data = [(1, bytearray(build([(0, 0, 4, 2, [1] * 8, 1, None, 5, False)]))), (2, None), (3, bytearray(b"no gif"))]
    out = {x["id"]: x["frames"] for x in gif.frames(spark.createDataFrame(data, "id int, data binary")).collect()}
    assert out[2] is None and out[3] is None and out[1][0]["colour_histogram"][48] == 8 and len(out[1][0]["pixels"]) == 32


def test_query_feature_counts_colours_of_composed_frames(spark, docs):
    text = "AbC\u00fc \u65e5 " * 9000
    n, payload = gif.payload_of(text)
    row = gif.stored_row(text)
    want = [0] * 64
    for b in payload:  # two bits a channel of the palette 3-3-2
        want[(b >> 6) * 16 + (b >> 3 & 3) * 4 + (b & 3)] += 1
    assert row[:5] == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(gif.encode_samples(payload)))
    assert row[6] == f"frames={-(-len(payload) // (192 * 4096))};duration_cs={10 * -(-len(payload) // (192 * 4096))};colours=" + ",".join(map(str, want))
    two = gif.stored_row("x" * (192 * 4096 + 5))
    assert two[6].startswith("frames=2;duration_cs=20;") and sum(map(int, two[6].split("colours=")[1].split(","))) == two[1]


def test_files_that_declare_too_much_are_null(spark):
    huge = b"GIF89a" + (60000).to_bytes(2, "little") * 2 + b"\0\0\0" + b"\x2c\0\0\0\0" + (60000).to_bytes(2, "little") * 2 + b"\0\x02\x02\x4c\x01\0\x3b"
    with pytest.raises(ValueError):
        gif.decode(huge)
    good = gif.encode_samples(bytes(range(192)))
    with pytest.raises(ValueError):
        gif.decode(good, limit=100)
    df = spark.createDataFrame([(1, huge), (2, good), (3, None)], "id int, data binary")
    got = {x["id"]: x["frames"] for x in gif.frames(df).collect()}
    assert got[1] is None and got[3] is None and got[2][0]["width"] == 192


def test_texts_above_the_limit_of_composed_samples_are_stored_all_the_same(monkeypatch):
    """The limit guards against files that are read as a whole; the query's own media is read frame by frame."""
    text = "é and more; " * 200_000
    want = gif.stored_row(text)
    monkeypatch.setattr(gif, "MAX_SAMPLES", gif.WIDTH * gif.ROWS)
    assert gif.stored_row(text) == want and want[0] == len(text.encode())
    assert want[2] == hashlib.sha256(gif.payload_of(text)[1]).hexdigest() and want[3] == zlib.crc32(gif.payload_of(text)[1][-16:])
    assert want[6].startswith("frames=4;duration_cs=40;")
    with pytest.raises(ValueError):
        gif.decode(gif.encode_samples(gif.payload_of(text)[1]), limit=gif.MAX_SAMPLES)


def plain_lzw_decode(data: bytes, bits: int) -> bytes:
    """Code by code; up to the first code that cannot be explained."""
    clear, stop = 1 << bits, (1 << bits) + 1
    number, at, out, book, last = int.from_bytes(data, "little"), 0, [], None, b""
    book = [bytes([i]) for i in range(clear)] + [b"", b""]
    seen = 0
    while True:
        width = min(12, max(bits + 1, (clear + 2 + max(0, seen - 1)).bit_length()))
        if at + width > len(data) * 8:
            return b"".join(out)
        c, at = number >> at & ((1 << width) - 1), at + width
        if c == clear:
            book, last, seen = book[: clear + 2], b"", 0
            continue
        if c == stop or c > len(book) or (c == len(book) and not last):
            return b"".join(out)
        x = book[c] if c < len(book) else last + last[:1]
        if last and len(book) < 4097:
            book.append(last + x[:1])
        out.append(x)
        last, seen = x, seen + 1


def test_strings_are_followed_back_as_a_plain_decoder_builds_them():
    r = random.Random(5)
    for case in range(120):
        bits = r.choice([2, 4, 8])
        n = r.choice([0, 1, 40, 700, 9000])
        d = bytes(r.choices(range(1 << bits), weights=[2.0**-j for j in range(1 << bits)], k=n)) if case % 3 else bytes(n)
        code = bytearray(gif.lzw_encode(d, bits))
        assert gif.lzw_decode(bytes(code), bits, n) == d
        for _ in range(r.randint(1, 3)):
            code[r.randrange(len(code))] = r.randrange(256)
        want = plain_lzw_decode(bytes(code), bits)
        assert gif.lzw_decode(bytes(code), bits, len(want) + 3) == want + bytes(3)
        assert gif.lzw_decode(bytes(code), bits, len(want) // 2) == want[: len(want) // 2]


def test_decoding_makes_no_call_a_code():
    words = [f"word{i * i % 997} " for i in range(400)]
    samples = "".join(random.Random(2).choices(words, k=8000)).encode()
    code, run = gif.lzw_encode(samples), cProfile.Profile()
    run.enable()
    back = gif.lzw_decode(code, 8, len(samples))
    run.disable()
    assert back == samples and sum(x.callcount for x in run.getstats()) < len(code) // 8
