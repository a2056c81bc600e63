"""GIF media, byte-level BPE, chat formatting, WARC archives and packing: exact round trips."""

import hashlib
import json
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from typeweave.llm import bpe_words, byte_bpe, chat_format, gif_media, packing, warc

TEXTS = [None, "", "a", "Hello  world\n\n it's   fine", "né 漢字 😀 ́x", "x" * 5000, " " * 3000, "the " * 3000, "<|endoftext|> <|im_end|>", "\0 \x1c tab\t", "the same", "the same"]


# GIF


@given(st.binary(min_size=1, max_size=6000), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_gif_keeps_payloads(data, rows):
    payload = data + bytes(-len(data) % 64)
    assert gif_media.read_payload(gif_media.write_gif(payload, frame_rows=rows))[0] == payload


@pytest.mark.parametrize("bits", range(2, 9))
def test_lzw(bits):
    rng = random.Random(bits)
    for data in (b"", bytes(5000), bytes(rng.randrange(1 << bits) for _ in range(20_000)), bytes([1, 0] * 9000)):
        assert gif_media.lzw_decode(gif_media.lzw_encode(data, bits), bits, len(data)) == data


def _gif(frames, palette, size=(4, 2)):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(v for c in palette for v in c)
    for box, samples, disposal, transparent, delay, local, interlaced in frames:
        flags = disposal << 2 | (transparent is not None)
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", flags, delay, transparent or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", *box, (0x81 if local else 0) | (0x40 if interlaced else 0))
        out += bytes(v for c in local or () for v in c) + b"\x02" + gif_media._blocks(gif_media.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


PALETTE = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]


def test_palettes_transparency_disposal_and_timing():
    local = [(9, 9, 9), (8, 8, 8), (7, 7, 7), (6, 6, 6)]
    data = _gif(
        [
            ((0, 0, 4, 2), [1] * 8, 1, None, 10, None, False),
            ((1, 0, 2, 1), [2, 3], 3, 3, 20, None, False),  # is undone afterwards; its second pixel is transparent
            ((0, 1, 1, 1), [0], 2, None, 30, local, False),  # is cleared afterwards
            ((3, 0, 9, 1), [2] * 9, 0, None, 0, None, False),  # reaches beyond the canvas
        ],
        PALETTE,
    )
    shown = [(f.start_cs, f.delay_cs, [tuple(p) for p in f.canvas.reshape(-1, 4).tolist()]) for f in gif_media.read_gif(data)]
    red, green, grey, gone = (255, 0, 0, 255), (0, 255, 0, 255), (9, 9, 9, 255), (0, 0, 0, 0)
    assert [s[:2] for s in shown] == [(0, 10), (10, 20), (30, 30), (60, 0)]
    assert shown[0][2] == [red] * 8
    assert shown[1][2] == [red, green] + [red] * 6
    assert shown[2][2] == [red] * 4 + [grey] + [red] * 3
    assert shown[3][2] == [red] * 3 + [green] + [gone] + [red] * 3


def test_interlaced_frames():
    rows = [r for r in range(10) for _ in range(2)]
    order = gif_media._interlaced_rows(10)
    data = _gif([((0, 0, 2, 10), [v % 4 for r in order for v in (r, r)], 0, None, 0, None, True)], PALETTE, (2, 10))
    (frame,) = gif_media.read_gif(data)
    assert [tuple(p) for p in frame.canvas.reshape(-1, 4)[:, :3].tolist()] == [PALETTE[r % 4] for r in rows]


def test_bad_gifs(shipped):
    good = gif_media.write_gif(bytes(64))
    for bad in (b"", b"PNG" * 9, good[:50], good[:-20]):
        with pytest.raises(ValueError):
            list(gif_media.read_gif(bad))
    df = shipped.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    rows = gif_media.frames(df, skip_errors=True).collect()
    assert [(r.id, r.frame, r.width, r.height, r.colours[0], sum(r.colours)) for r in rows] == [(1, 0, 64, 1, 64, 64)]


def test_texts_as_gifs(docs):
    rows = {r.doc_id: r for r in gif_media.digests(gif_media.store(docs(list(enumerate(TEXTS))))).collect()}
    assert len(rows) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(gif_media.write_gif(payload)).hexdigest()
    assert rows[10].feature == rows[11].feature
    assert gif_media.digests(gif_media.store(docs([]))).collect() == []


# BPE


def _tiktoken():
    ranks = bpe_words.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = list("ab  \n\t\r'sté’漢字😀\u0085  \x1c᠎1२½Ⅷ!?.-_<|>ŉ́​　﻿\x00\x0b") + [" the", " 're", "'ll", "  "]


def test_encoders_agree_with_their_libraries():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(4000)] + TEXTS[1:]
    ours, theirs = bpe_words.load_ranks(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)[0], _tiktoken()
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(part)] == [theirs.encode_ordinary(t) for t in part]
    path = public_tokenizers.path(packing.TOKENIZER)
    wanted = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for encoder in (bpe_words.load_json(path, public_tokenizers.PATTERN), bpe_words.load_json_ranks(path, public_tokenizers.PATTERN)):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == wanted


def test_ranks_are_taken_only_where_ids_follow_the_merges(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert isinstance(bpe_words.load_json_ranks(path, public_tokenizers.PATTERN), bpe_words.RankEncoder)
    with open(path) as f:
        made = json.load(f)
    merges = made["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    (tmp_path / "other.json").write_text(json.dumps(made))
    other = bpe_words.load_json_ranks(str(tmp_path / "other.json"), public_tokenizers.PATTERN)
    assert isinstance(other, bpe_words.PieceEncoder)
    texts = ["the cat and a hat", " t a", ""]
    library = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe_words, "CACHE_PIECES", 5)
    encoder = bpe_words.load_json(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.PATTERN)
    texts = ["one two three four five six seven", "one two", "eight nine ten eleven twelve", "one two three"] * 3
    wanted = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids for k in range(0, len(texts), 2) for ids in encoder.encode(texts[k : k + 2])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == wanted
    assert len(encoder.pieces) <= 6


def test_encode_and_decode(docs):
    encoded = byte_bpe.encode(docs(list(enumerate(TEXTS))), offsets=True)
    library = _tiktoken()
    for r in encoded.collect():
        text = TEXTS[r.id] or ""
        assert r.ids == library.encode_ordinary(text)
        data = text.encode()
        spans = [(text[a:b].encode(), library.decode_single_token_bytes(t)) for a, b, t in zip(r.starts, r.ends, r.ids)]
        assert all(piece in span for span, piece in spans)
        assert b"".join(p for _, p in spans) == data
    for r in byte_bpe.decode(encoded).collect():
        assert bytes(r.bytes) == (TEXTS[r.id] or "").encode() and r.text == (TEXTS[r.id] or "")
    for r in byte_bpe.digests(encoded.select("id", "ids")).collect():
        ids = library.encode_ordinary(TEXTS[r.id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.id] or "").encode()).hexdigest()
    assert byte_bpe.digests(byte_bpe.encode(docs([]))).collect() == []


def test_cut_characters_decode_to_replacements(shipped):
    ids = _tiktoken().encode_ordinary("漢字😀")
    rows = byte_bpe.decode(shipped.createDataFrame([(1, ids[:-1]), (2, None)], "id long, ids array<int>")).collect()
    assert rows[0].text.endswith("�") and "😀".encode()[:1] in bytes(rows[0].bytes)
    assert bytes(rows[1].bytes) == b""


# chat


@given(st.text(alphabet="<|\\im_end>a\n", max_size=30))
@settings(max_examples=300)
def test_escapes_are_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text
    assert "\n" not in chat_format.escape_role(text)


def test_conversations(shipped):
    rows = [
        (1, 0, "user", "hi <|im_end|>"),
        (1, 1, "assistant", "<|im_start|>assistant\nyes <\\|"),
        (1, 2, "assistant", None),
        (1, 3, "assistant", "more 😀"),
        (2, 1, "assistant", "second"),
        (2, 0, None, ""),
        (3, None, "a\nb\\", "odd <|role|>"),
        (None, 0, "user", "no id"),
        (4, 0, "user", "tie b"),
        (4, 0, "user", "tie a"),
        (4, 0, "user", "tie a"),
    ]
    df = shipped.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, ids string, mask string")
    formatted = chat_format.format_turns(df)
    for r in formatted.collect():
        assert sum(r.mask) == (len([m for m in r.mask if m]) if r.role == "assistant" else 0)
        assert r.ids.count(chat_format.START_ID) == 1 and r.ids.count(chat_format.END_ID) == 1
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in own).encode()).hexdigest()
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(24 + len(chat_format.escape_role(role)) + len(chat_format.escape(text)) for _, _, role, text in own)
    assert chat_format.digests(chat_format.format_turns(df.limit(0))).collect() == []


# WARC


def test_archives(shipped, tmp_path):
    long = "<p>the same page</p>" * 20
    rows = [
        (5, "http://a/5", long),
        (2, "http://a/2", long),
        (9, None, long),
        (3, "http://a/3", "short"),
        (4, "http://a/4\r\nX: y", "short"),
        (6, "http://a/6", None),
        (7, "http://a/7", ""),
        (8, "http://a/8", "é" * 70_000),
        (None, "http://a/n", long),
        (2, "http://a/2", long),
        (5, "http://a/5", "another page of id 5, which is a response of its own because no other page has this payload at all"),
    ]
    df = shipped.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/archives"
    written = warc.write(df, path, archive_bytes=2000).collect()
    assert sum(r.records for r in written) == len(rows)
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.digest) for r in warc.read(shipped, path).collect())
    wanted = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = html == long and page in (5, 9)
        wanted.append((str(page), "revisit" if revisit else "response", 2 if revisit else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(wanted, key=lambda r: (r[0], r[1], r[2] or 0))
    data = (tmp_path / "archives" / written[0].archive).read_bytes()
    size = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_MAGIC
    assert size > 0
    frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert frame.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert not [p for p in (tmp_path / "archives").iterdir() if p.name.startswith("_")]
    (tmp_path / "archives" / "part-99999999-00000.warc.zst").write_bytes(data)  # of a write that was given up
    names = shipped.createDataFrame([(w.archive,) for w in written], "archive string")
    assert warc.read(shipped, path, names).count() == len(rows)
    again = warc.write(df, f"file://{tmp_path}/again", archive_bytes=2000).collect()
    for w in again:
        assert (tmp_path / "again" / w.archive).read_bytes() == (tmp_path / "archives" / w.archive).read_bytes()


def test_dictionaries_come_from_whole_archives(monkeypatch):
    monkeypatch.setattr(warc, "TRAIN_BYTES", 64 << 10)
    records = [bytes([65 + k // 10]) * 5000 for k in range(200)]
    pieces = warc.training_pieces(records)
    assert sum(map(len, pieces)) <= 64 << 10 and len({p[:1] for p in pieces}) >= 12 and {p[:1] for p in pieces} & {b"R", b"S", b"T"}
    for few in ([b"WARC/1.1 one"], [b"WARC/1.1 one", b"WARC/1.1 two" * 9], [bytes(range(256)) * 40] * 30):
        assert list(warc.read_archive(warc.write_archive(few))) == few


def test_empty_and_damaged_archives(shipped, tmp_path):
    empty = shipped.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(empty, f"file://{tmp_path}/none").collect() == []
    data = warc.write_archive([warc.write_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)])
    assert warc.parse_record(next(warc.read_archive(data)))[1].endswith(b"abc")
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_archive(b"x" * 20))


def test_record_ids_give_page_ids():
    for page in (0, 1, -1, 2**62, -(2**63)):
        assert warc.page_of(warc.record_id(page)) == page
    assert warc.page_of(warc.record_id(None, "1/2/3")) is None and warc.record_id(None, "1/2/3") != warc.record_id(None, "1/2/4")


# packing


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(histogram):
    bins = packing.plan(histogram, 64)
    placed: dict[int, int] = {}
    for group in bins:
        assert sum(length * times for length, times in group.content) == 64 - group.free
        for length, times in group.content:
            placed[length] = placed.get(length, 0) + times * group.count
    assert placed == histogram
    room: list[int] = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [(free, k) for k, free in enumerate(room) if free >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(64 - length)
    assert sum(group.count for group in bins) == len(room)


def test_pack(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id")]
    packed = packing.pack(docs(rows), size=16).collect()
    whole: dict = {}
    for r in packed:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length <= 16
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
    for k, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted(whole[k])
        copies = sum(k == other for other, _ in rows)
        assert len(pieces) == copies * -(-len(ids) // 16)
        if copies == 1:
            assert [i for _, _, p in pieces for i in p] == ids
            assert [s for _, s, _ in pieces] == list(np.cumsum([0, *(len(p) for _, _, p in pieces)])[:-1])
    by_sequence: dict = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 16
    assert packing.pack(docs([])).collect() == []
