"""Alignment, id files and spelling variants: brute force, round trips, and the awkward rows."""

from __future__ import annotations

import random

import brute_tokens as brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pricetide.llm import alignment, packing, pieces, registered, variants
from pricetide.session import scratch_folder

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  two  spaces ", "a▁b", "plain words here", "tab\there\r\nand   there", "x", "<|endoftext|> and </s> <s>",
    "中文 字。 \U0001f642 \U0001f642", "e ́ é é", "don't 's  't it's", "<0x41> \x00 \x1c y \x85 z", "　 wide   x",
    "z" * 5000, "word " * 2000, "it's à la carte, naïve café", "A a A a", "ﬁ ① Ａ İI", "a\x7fb \x7f \x7f\x7f c", "end ", "กำ   x",
]


def docs_of(spark, rows):
    """doc_id, text and columns whose names the operators use themselves."""
    rows = [(i, t, 1, "k", 7) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, word string, chunk long")


def random_rows(seed, n=60):
    rng = random.Random(seed)
    alphabet = "abe é́ .'\n\t12中\U0001f642▁ <|>"
    return [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return sorted(documents.select("doc_id", "text").collect())


# ---- alignment -----------------------------------------------------------------------------------

ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(found):
    return sorted((tuple(r) for r in found), key=lambda r: (r[0] is None, r))


def test_alignment_against_brute_force(spark, rows):
    got = registered.op11_token_alignment(spark, SF)
    assert got.columns == ALIGNED
    assert plain(got.collect()) == plain(brute.alignments(rows))


@pytest.mark.parametrize("seed", range(3))
def test_alignment_of_odd_rows(spark, seed):
    rows = [*enumerate(ODD), (None, "plain words here"), (5, "plain words here"), *random_rows(seed)]
    got = alignment.alignments(docs_of(spark, rows).repartition(3), *PATHS, chunk_bytes=700)
    assert plain(got.select(*ALIGNED).collect()) == plain(brute.alignments(rows))
    assert {r.groups for r in got.where("n_a = 0").collect()} == {""}


def test_pair_counts_and_empty_tables(spark):
    rows = [(1, "one two"), (2, "one one"), (3, "two")]
    got = {(r.a_id, r.b_id): (r.documents, r.best) for r in alignment.pair_counts(docs_of(spark, rows), *PATHS).collect()}
    a, b = brute.SIDE_A.encode(" one").ids, brute.SIDE_B.encode("one")
    assert got[a[0], b[0]] == (2, True) and len(got) == 2
    assert alignment.alignments(docs_of(spark, rows).limit(0), *PATHS).count() == 0
    assert alignment.alignments(docs_of(spark, [(1, None), (2, "")]), *PATHS).select("n_links", "count_sum").distinct().collect() == [(0, 0)]


def test_a_long_group_sends_no_pair_per_link(spark):
    """Repeats inside a group meet as counts: n_links is their product, the pairs are few."""
    ids, at = np.array([3, 3, 3, 4]), np.zeros(4, np.int64)
    table = alignment._counted({"g": at, "a": ids})
    assert sorted(zip(table["a"].to_pylist(), table["count_all"].to_pylist())) == [(3, 3), (4, 1)]


# ---- pieces --------------------------------------------------------------------------------------


def test_pieces_give_the_texts_again():
    texts = [" " + t for t in ODD if t] + ["", "", " last"]
    distinct, places, offsets = pieces.spaced(pa.array(texts))
    parts = distinct.to_pylist()
    again = [b"".join(parts[p] for p in places[s:e]).decode() for s, e in zip(offsets[:-1], offsets[1:])]
    assert again == texts
    distinct, places, offsets = pieces.words(pa.array(texts))
    parts = distinct.to_pylist()
    for text, s, e in zip(texts, offsets[:-1], offsets[1:]):
        assert [parts[p].decode() for p in places[s:e]] == [w for w in text.replace("\x0b", " ").translate({c: " " for c in (9, 10, 12, 13)}).split(" ") if w]


def test_tables_of_bounded_size():
    texts = ["a" * n for n in (10, 900, 20, 5000, 0, 0, 30)] + [None] * 200
    batches = pa.table({"text": texts}).to_batches(max_chunksize=3)
    tables = list(pieces.sized(iter(batches), "text", 1000))
    assert [t for table in tables for t in table["text"].to_pylist()] == texts
    assert max(table.num_rows for table in tables) <= 16
    assert all(sum(len(t or "") + 64 for t in table["text"].to_pylist()) <= 1100 or table.num_rows == 1 for table in tables)


# ---- id files ------------------------------------------------------------------------------------


def test_id_files_against_the_library(spark, rows):
    got = registered.op12_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == brute.id_rows(rows)


def test_id_files_of_odd_rows(spark):
    rows = [(None, "no id"), (-3, "below")] + [(k, t) for k, t in enumerate(ODD + [t for _, t in random_rows(9)])]
    folder = scratch_folder(spark)
    frame = docs_of(spark, rows).repartition(5)
    packing.write(frame, folder, WORD_BPE, 49_408, end=1, block_ids=7, text_bytes=900)
    got = packing.read(spark, folder)
    assert [tuple(r)[:4] for r in got.orderBy(got.doc_id.asc_nulls_first()).collect()] == brute.id_rows(rows)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got.collect()}
    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert all(ids[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows)


def test_repeated_ids_and_empty_tables_of_ids(spark):
    rows = [(4, "same"), (4, "same"), (4, "other words"), (1, "first")]
    folder = scratch_folder(spark)
    packing.write(docs_of(spark, rows), folder, WORD_BPE, 49_408)
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in packing.read(spark, folder).collect())
    assert [r[0] for r in got] == [1, 4, 4, 4] and got[0] == (1, 0, 1)
    assert [r[1] for r in got][1:] == np.cumsum([r[2] for r in got])[:-1].tolist()
    folder = scratch_folder(spark)
    packing.write(docs_of(spark, rows).limit(0), folder, WORD_BPE, 49_408)
    assert packing.read(spark, folder).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 15, 16, 17, 24, 31, 32])
def test_packing_and_random_access(bits):
    rng = np.random.default_rng(bits)
    lists = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 300, 0, 64, 17)]
    content = b"".join(s + b"\n" for s in packing.sections(iter(enumerate(lists)), bits, block_ids=50))
    file = packing.IdFile(content)
    assert [file.document(k).tolist() for k in range(len(lists))] == [x.tolist() for x in lists]
    flat = np.concatenate(lists)
    assert all(file.ids(a, b).tolist() == flat[a:b].tolist() for a, b in ((0, 387), (49, 51), (100, 150), (386, 387), (7, 7)))
    assert len(file.offsets) == -(-len(flat) // 50)
    with pytest.raises(ValueError):
        packing.IdFile(content[:-9])


def test_width_is_the_least():
    assert [packing.width(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


# ---- variants ------------------------------------------------------------------------------------


def variant_rows(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.collect())


def test_variants_against_brute_force(spark, rows):
    got = registered.op13_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variant_rows(got) == brute.variants(rows)
    assert got.where("form IS NOT NULL").count() > 0


@pytest.mark.parametrize("filter_bytes", [variants.FILTER_BYTES, 64])
def test_variants_of_odd_rows(spark, filter_bytes):
    """Chains of forms, ties, equal neighbours, letters outside ASCII; the result is the same with filters that let all through."""
    word = "lanterna"
    text = " ".join([word] * 1200 + ["lanterne"] * 110 + ["lantérne"] * 9 + ["llanterna"] * 40 + ["lantern"] * 40 + ["lanternà"] * 3)
    texts = [None, "", text, "AAAAAAA aaaaaaaa AAAAAAa aaaaaaaa", "ÀÉÎÕÜÝß ÀÉÎÕÜÝß àéîõüýß àéîõüýß", "short words only", "mississippi misissippi " * 2, "x" * 9000 + " " + "x" * 9000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "lanternas lanternas"), (2, "lanternas")]
    got = variants.variants(docs_of(spark, rows), filter_bytes=filter_bytes)
    assert variant_rows(got) == brute.variants(rows)
    roots = {r.word: r.root for r in got.collect()}
    assert roots["lantérne"] == word


def test_variants_of_random_words(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(200))) for k in range(20)]
    assert variant_rows(variants.variants(docs_of(spark, rows))) == brute.variants(rows)


def test_variants_of_empty_tables(spark):
    empty = docs_of(spark, [(1, None)])
    assert variants.variants(empty.limit(0)).count() == variants.variants(empty).count() == 0
    assert variant_rows(variants.variants(docs_of(spark, [(1, "solitary solitary")]))) == brute.variants([(1, "solitary solitary")])
