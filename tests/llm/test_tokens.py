"""BPE, token files and token counts against the tokenizers library, on odd and ordinary texts."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from veldra.llm import bpe, queries, token_counts, token_files  # noqa: E402
from veldra.llm.word_pieces import word_pieces  # noqa: E402

BYTE, WORD = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n  x", "It's THE 'llama' we'll see; don't!", "a" * 5000, "ab " * 40_000, "naïve Café ÉÀ ß", "İstanbul ǅ ſ", "中文 かな 한글 😀👍🏽", "<|endoftext|>x<|startoftext|> <|endof", "\x00\x1c\x85​ x́", "12345 1,2.5 ²¼", "!!!??? ...", "tab\tnew\rline\x0bfeed\x0c"]


@pytest.fixture(scope="module")
def libraries():
    return tokenizers.Tokenizer.from_file(BYTE), tokenizers.Tokenizer.from_file(WORD)


def test_bpe_of_odd_texts(spark, docs_of, libraries):
    rows = {r.doc_id: r for r in bpe.encode_decode(docs_of([*ODD, ODD[4]]), BYTE).collect()}
    assert len(rows) == len(ODD) + 1
    for i, text in enumerate([*ODD, ODD[4]]):
        want = libraries[0].encode(text or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == want and rows[i].decoded == libraries[0].decode(want, skip_special_tokens=False)


def test_encode_and_decode_are_parts_of_the_round_trip(spark, docs_of):
    encoded = bpe.encode(docs_of(ODD), BYTE)
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, BYTE).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(docs_of(["x"]).where("false"), BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcdeST'tsrvlm 09\n\t.,!é€ß<|>endoftxAÀİ中😀ǅſ\x1c\x85́")), max_size=40))
def test_any_text(text):
    own = bpe.codec(BYTE)
    want = _library(BYTE).encode(text, add_special_tokens=False).ids
    got = own.encode_batch([text])[0]
    assert got.tolist() == want and own.decode(got) == _library(BYTE).decode(want, skip_special_tokens=False)
    ids, counts = word_pieces(WORD).encode_texts(pa.array([text, "", text], pa.string()))
    want = _library(WORD).encode(text, add_special_tokens=False).ids
    assert counts.tolist() == [len(want), 0, len(want)] and ids.tolist() == want * 2


def _library(path, held={}):  # noqa: B006
    if path not in held:
        held[path] = tokenizers.Tokenizer.from_file(path)
    return held[path]


def test_partial_characters_decode_as_the_library_does(libraries):
    own, rnd = bpe.codec(BYTE), random.Random(2)
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(256), rnd.randrange(50_257)]) for _ in range(rnd.randrange(8))]
        assert own.decode(np.array(ids, dtype=np.int64)) == libraries[0].decode(ids, skip_special_tokens=False)


def test_a_disordered_vocabulary_is_refused(tmp_path):
    import json

    with open(BYTE) as file:
        spec = json.load(file)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="later merge"):
        bpe.PairIndexCodec(str(tmp_path / "v.json"))


def test_caches_may_be_emptied(monkeypatch, libraries):
    from veldra.llm import word_pieces as module

    monkeypatch.setattr(module, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    own, words = bpe.PairIndexCodec(BYTE), module.WordPieces(WORD)
    for text in [" ".join(f"w{i}x" for i in range(j, j + 30)) for j in (0, 1, 40, 41, 0, 90, 2)]:
        assert own.encode_batch([text])[0].tolist() == libraries[0].encode(text).ids
        assert words.encode_texts(pa.array([text]))[0].tolist() == libraries[1].encode(text, add_special_tokens=False).ids


def test_token_counts(spark, docs_of, libraries):
    rows = {r.doc_id: r for r in token_counts.token_counts(docs_of(ODD), WORD).collect()}
    for i, text in enumerate(ODD):
        assert rows[i].n_bytes == len((text or "").encode()) and rows[i].n_tokens == len(libraries[1].encode(text or "", add_special_tokens=False).ids)
    assert token_counts.token_counts(docs_of(["x"]).where("false"), WORD).count() == 0


def test_token_files(spark, docs_of, libraries, tmp_path):
    order = list(range(len(ODD)))
    random.Random(1).shuffle(order)
    docs = docs_of([*((3 * i, ODD[i]) for i in order), (0, "same id, later text")])
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, WORD, path, end_id=2)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    texts = [(0, ""), (0, "same id, later text"), *((3 * i, ODD[i]) for i in range(1, len(ODD)))]
    start = 0
    for row, (doc, text) in zip(rows, texts, strict=True):
        want = [*libraries[1].encode(text, add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, list(row.tokens)) == (doc, start, len(want), want)
        start += len(want)
    some = token_files.read_token_files(spark, path, where=F.col("doc_id").between(6, 12), tokens=False)
    assert sorted(r.doc_id for r in some.collect()) == [6, 9, 12] and "tokens" not in some.columns
    with pytest.raises(Exception, match="(?i)exist"):
        token_files.write_token_files(docs, WORD, path, end_id=2)


def test_token_file_format(spark, docs_of, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "t"
    token_files.write_token_files(docs_of([f"word{i % 7} and more" for i in range(3000)]), WORD, str(path), end_id=2)
    files = [pq.ParquetFile(f).metadata for f in path.glob("part-*")]
    for meta in files:
        columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
        assert all(c.has_column_index and c.has_offset_index for n, c in columns.items() if n != "tokens.list.element") and columns["tokens.list.element"].has_offset_index
    plan = token_files.read_token_files(spark, str(path), where=F.col("doc_id") < 5, tokens=False)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,5)]" in plan and "tokens:array" not in plan.split("Physical Plan")[1]


def test_an_empty_table_of_token_files(spark, docs_of, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_token_files(docs_of(["x"]).where("false"), WORD, path, end_id=2)
    assert token_files.read_token_files(spark, path).count() == 0


def test_registered_queries(spark, sf_dir, libraries):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    word = [e.ids for e in libraries[1].encode_batch(docs.text.tolist(), add_special_tokens=False)]
    byte = [e.ids for e in libraries[0].encode_batch(docs.text.tolist(), add_special_tokens=False)]
    files = queries.op3_token_files(spark, sf_dir).toPandas().set_index("doc_id")
    counts = queries.op5_token_counts(spark, sf_dir).toPandas().set_index("doc_id")
    digests = queries.op4_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(files) == len(counts) == len(digests) == len(docs)
    start = 0
    for doc, text, w, b in zip(docs.doc_id, docs.text, word, byte):
        ids = np.array([*w, 2], dtype="<u4")
        assert tuple(files.loc[doc, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        assert tuple(counts.loc[doc, ["n_bytes", "n_tokens", "over_limit"]]) == (len(text.encode()), len(w), len(w) > 2048)
        assert tuple(digests.loc[doc, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(b), hashlib.sha256(",".join(map(str, b)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_pieces_are_known_once_and_repeated_chunks_agree(libraries):
    from veldra.llm import word_pieces as module

    own = module.WordPieces(WORD)
    texts = pa.array(["one two two, three!", "", "two THREE don't 42", "x  　y <|endoftext|>two", " "] * 2, pa.string())
    for _ in range(2):
        counts = own.count_texts(texts)
        assert counts.tolist() == [len(e.ids) for e in libraries[1].encode_batch(texts.to_pylist(), add_special_tokens=False)]
    words = own.counts.words.to_pylist()
    assert len(words) == len(set(words)) and "two" in words and "two," not in words
    assert not len(own.counts.ids) and not len(own.pieces.words)  # no ids are made or kept
    codes, bounds, distinct = own.pre.split(texts)
    for row, text in enumerate(texts.to_pylist()):
        assert [w for c in codes[bounds[row] : bounds[row + 1]] if (w := distinct[int(c)].as_py())] == own.pre.cut(text)


def test_files_that_are_handled_otherwise_are_refused(tmp_path):
    import json

    from veldra.llm import word_pieces as module

    changes = {
        BYTE: [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("ignore_merges", True), ("lstrip", True)],
        WORD: [("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("end_of_word_suffix", None), ("single_word", True)],
    }
    for path, own in changes.items():
        for key, value in own:
            with open(path) as file:
                spec = json.load(file)
            holder = spec if key in spec else spec["model"] if key in ("ignore_merges", "end_of_word_suffix") else spec["added_tokens"][0]
            holder[key] = value
            (tmp_path / "v.json").write_text(json.dumps(spec))
            with pytest.raises(ValueError, match="reads|plain string"):
                bpe.PairIndexCodec(str(tmp_path / "v.json")) if path == BYTE else module.PreTokens(str(tmp_path / "v.json"))


def test_special_tokens_of_any_form(tmp_path):
    import json

    with open(BYTE) as file:
        spec = json.load(file)
    spec["added_tokens"] += [{**spec["added_tokens"][0], "content": "[unk]", "id": 50_257}]
    path = str(tmp_path / "v.json")
    (tmp_path / "v.json").write_text(json.dumps(spec))
    library = tokenizers.Tokenizer.from_file(path)
    for text in ("a [unk] b", "[unk]", "no <|endoftext|>[unk]x", "none"):
        assert bpe.PairIndexCodec(path).encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_one_id_goes_over_many_files(spark, docs_of, libraries, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 200)
    texts = ["the same text of one id"] * 200 + [f"text {i:03d} of it" for i in range(100)]
    docs = docs_of([*((7, t) for t in texts), (None, "no id"), (3, "before"), (9, "after")])
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, WORD, path, end_id=2)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert len(list((tmp_path / "t").glob("part-*"))) > 10
    start = 0
    for row, text in zip(rows, ["no id", "before", *sorted(texts), "after"], strict=True):
        want = [*libraries[1].encode(text, add_special_tokens=False).ids, 2]
        assert (row.start, list(row.tokens)) == (start, want)
        start += len(want)
