"""BPE and packing against the tokenizers library and exact round trips."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing, pretokens
from corpusloom.llm.arrowtext import utf8_buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(texts):
    offsets, body = utf8_buffers(pa.array(texts, pa.string()))
    ids, starts = bpe.encoder(PATH).encode(offsets, body)
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)], bpe.encoder(PATH).decode(ids, starts)


def test_odd_strings_encode_as_the_library_does():
    random.seed(5)
    alphabet = list("ab'stremvld  \n\t.,!1²½ßäé中  　\x1c\x85​😀") + ["'s", "'re", "<|endoftext|>", "  ", "\n\n", "'ll", "aaa"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(5000)] + ["", "<|endof", "text|>"]
    got, _ = ids_of(texts)
    assert got == [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=6))
def test_any_text_round_trips(texts):
    got, (chars, starts) = ids_of(texts)
    assert got == [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]
    raw = chars.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, starts[1:], strict=False)] == texts


def test_encode_and_decode_frames(spark, odd, empty, sample):
    for df in (odd, sample[0]):
        rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
        want = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in df.select("doc_id", "text").collect())
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.decoded) for r in rows) == want
        for r in rows:
            assert [*np.frombuffer(bytes(r.ids), "<u4")] == LIBRARY.encode(r.decoded, add_special_tokens=False).ids
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    broken = spark.createDataFrame([(1, struct.pack("<I", LIBRARY.encode("é").ids[0])), (2, None)], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in bpe.decode(broken, PATH).collect()} == {1: LIBRARY.decode(LIBRARY.encode("é").ids[:1], skip_special_tokens=False), 2: ""}


def check_packing(rows, texts, capacity=1024):
    """texts: list of (doc_id, text), ids unique.  Returns the share of padding."""
    want = {k: LIBRARY.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.length == len(ids) > 0
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    filled = lambda parts: [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert pieces.keys() == want.keys() and all(filled(p) and sum(n for _, n in p) == len(want[k]) for k, p in pieces.items())
    used = [sum(n for _, n in p) for p in sequences.values()]
    assert all(filled(p) for p in sequences.values()) and max(used) <= capacity
    padding = sum(0 if n & (n - 1) == 0 else capacity - n for n in used)
    return padding / (sum(used) + padding)


def test_packing(odd, empty, sample):
    df, texts = sample
    assert check_packing(packing.pack(df, PATH).collect(), [*texts.items()]) < 0.02
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert check_packing(packing.pack(once, PATH).collect(), [(r.doc_id, r.text) for r in once.select("doc_id", "text").collect()]) < 0.02
    assert packing.pack(empty, PATH).count() == 0
    repeated = packing.pack(odd, PATH).where("doc_id = 8 OR doc_id IS NULL").collect()
    assert sum(r.length for r in repeated if r.doc_id == 8) == 2 * repeated[0].doc_tokens


def test_a_run_gives_the_same_rows_again(sample):
    first, second = (sorted(map(tuple, packing.pack(sample[0], PATH).collect())) for _ in range(2))
    assert first == second


def test_long_texts_are_cut_where_pre_tokens_end():
    random.seed(9)
    text = "".join(random.choice(["word ", "a\nb", "don't ", "  12 3", "ünï cö ", "\n\n x", "<|endoftext|>", "中文 "]) for _ in range(4000))
    body = np.frombuffer(text.encode(), np.uint8)
    cuts = pretokens.safe_cuts(body, 500)
    assert cuts[0] == 0 and cuts[-1] == len(body) and len(cuts) > 20
    whole = LIBRARY.encode(text, add_special_tokens=False).ids
    encoder = bpe.encoder(PATH)
    assert [i for a, b in zip(cuts, cuts[1:], strict=False) for i in encoder.encode(np.array([0, b - a]), body[a:b])[0].tolist()] == whole
    long = "some words of a very long text, don't cut 'em\n" * 250_000
    offsets, body = utf8_buffers(pa.array(["x", long, "y"]))
    found = [*encoder.encode_rows(offsets, body)]
    assert [f[:2] for f in found] == [(0, 1), (1, 2), (2, 3)]
    assert found[1][2].tolist() == LIBRARY.encode(long, add_special_tokens=False).ids
    assert pretokens.safe_cuts(np.full(5000, 120, np.uint8), 500) == [0, 5000]
