import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from querylume.llm import separators, token_files, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = st.sampled_from([
    "the", "The", "ereou", "é", "É", "ñ", "ß", "ſ", "Σς", "İ", "é", "́", " ", "  ", "\n", "\t",
    "\x0b", "\x1c", " ", " ", ".", ",", "...", ".,", "!", "!.", "'s", "'", "don't", "12", "½", "²",
    "_", "-", "漢字", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "a.b", "x,y.",
])


@pytest.mark.parametrize("as_text", [False, True])
@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=25))
def test_as_the_library_encodes(as_text, parts):
    text = "".join(parts)
    LIBRARY.encode_special_tokens = as_text
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    model = tokens.encoder(PATH, special_as_text=as_text)
    assert np.frombuffer(model.encode([text])[0], "<u2").tolist() == want


def test_memory_is_bounded(monkeypatch):
    model = tokens.ChunkEncoder(PATH)
    monkeypatch.setattr(tokens, "MEMO", 50)
    LIBRARY.encode_special_tokens = False
    for i in range(30):
        text = " ".join(f"word{i}{j}, then" for j in range(20))
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(model.encode([text, None, ""])[0], "<u2").tolist() == want
    assert len(model.memo) < 200


TEXTS = [(5, "the end."), (1, None), (3, ""), (2, "a" * 30000), (9, "the the " * 9000), (3, "second three"),
         (None, "no id"), (4, "<|endoftext|> spelled")]


def test_token_files(spark, make_docs, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 3)
    manifest = token_files.write_token_files(make_docs(*TEXTS), PATH, end_id=2, length=16)
    rows = token_files.read_digests(manifest).collect()
    LIBRARY.encode_special_tokens = False
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text in order:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert all(n >= 1 for _, _, n, _ in map(tuple, rows))


def test_sequences_are_equal_and_mapped(tmp_path):
    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as sink:
        out = token_files.TokenWriter(sink, "<u2", 8)
        data = np.arange(5003, dtype="<u2")
        for a in range(0, 5003, 700):
            out.append(data[a:a + 700].tobytes())
        out.close()
    file = token_files.TokenFile(path)
    assert file.reader.schema.field("tokens").type == pa.list_(pa.uint16(), 8)
    got, mask = file.sequence(625)
    assert got.tolist() == [5000, 5001, 5002, 0, 0, 0, 0, 0] and mask.sum() == 3
    got, mask = file.sequence(300)
    assert got.tolist() == list(range(2400, 2408)) and mask.all()
    assert file.span(2040, 30).tolist() == list(range(2040, 2070))
    before = pa.total_allocated_bytes()
    held = [file.reader.get_batch(i) for i in range(file.reader.num_record_batches)]
    assert pa.total_allocated_bytes() - before < 1000 and held


def test_no_documents(spark, make_docs):
    none = make_docs("x").limit(0)
    assert token_files.read_digests(token_files.write_token_files(none, PATH, 2)).collect() == []
    files = separators.write_flat_files(none, PATH, 49407)
    assert separators.count_tokens(files, 49407).collect() == []


def test_separators_of_written_documents(spark, make_docs):
    files = separators.write_flat_files(make_docs(*TEXTS).coalesce(2), PATH, 49407)
    found = separators.count_tokens(files, 49407, block=64).collect()
    names = {r.path: r.doc_ids for r in files.collect()}
    LIBRARY.encode_special_tokens = True
    got = sorted((names[r.path][r.ordinal] or -1, r.n_tokens, r.ended) for r in found)
    want = sorted((i or -1, len(LIBRARY.encode(t or "", add_special_tokens=False).ids), True) for i, t in TEXTS)
    assert got == want


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separators_across_blocks(spark, tmp_path, block):
    ids = [5, 9, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 9, 9, 9, 4, 4]
    rows = []
    for name, n in (("a", len(ids)), ("b", 16), ("c", 0), ("d", 1)):
        path = str(tmp_path / name)
        np.array(ids[:n], "<u2").tofile(path)
        rows.append((path, n, "x"))
    frame = spark.createDataFrame(rows, "path string, n_ids long, block string")
    found = separators.count_tokens(frame, 9, block=block).collect()
    want = []
    for path, n, _ in rows:
        start, ordinal = 0, 0
        for i, x in enumerate(ids[:n]):
            if x == 9:
                want.append((path, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < n:
            want.append((path, ordinal, start, n - start, False))
    assert sorted(map(tuple, found)) == sorted(want)


def test_rows_of_one_id_are_cut_over_several_files(spark, make_docs):
    """Half of all rows without an id, half of these repeated."""
    rows = [(None, f"text {i % 150} of many words " * 3) for i in range(300)] + [(i, f"own text {i}") for i in range(300)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(make_docs(*rows).repartition(6), PATH, 2).cache()
        held = [sum(i is None for i in r.doc_ids) for r in manifest.orderBy("part").collect()]
        got = token_files.read_digests(manifest).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(held) == 300 and max(held) < 200 and sum(h > 0 for h in held) >= 3
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None] * 300 + list(range(300))
    ends = [0, *(r.start + r.n_tokens for r in by_start)]
    assert [r.start for r in by_start] == ends[:-1]
