import random
import zlib

import numpy as np
import pytest
from conftest import make_texts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from lodeframe.llm import concat_pack, tree_bpe  # noqa: E402
from lodeframe.llm.texts import block_of  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = (["a"], ["a", "b"], list("theinganдé中"), ["=", "-"], ["1", "2"], ["a", " ", "  ", "\n", "'s", "'", "\u00a0", "\u3000", "é", "中", "22", "!!", "<|endoftext|>", "\t", "the", "<|", "\x1c", "\x85", "\u2028"])


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return tree_bpe.model_of(f.read())


@pytest.mark.parametrize("leaf", [1, 3, 16, tree_bpe.LEAF])
def test_ids_equal_the_library_at_every_leaf_size(model, library, leaf):
    rng = random.Random(leaf)
    texts = ["", "  ", "<|endoftext|>", *("".join(rng.choices(a, k=rng.randint(1, 300))) for a in ALPHABETS for _ in range(40))]
    ids, counts = tree_bpe.encode_block(block_of(texts), model, leaf)
    found = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in found] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_documents_dealt_out_or_not_and_back(docs, empty, library):
    want = {t: library.encode(t or "", add_special_tokens=False).ids for t in {r.text for r in docs.collect()}}
    for far in (30, tree_bpe.SPREAD):
        coded = tree_bpe.encode(docs.withColumn("ids", docs.kept), PATH, keep=("doc_id", "text"), leaf=8, spread_from=far)
        rows = coded.collect()
        assert len(rows) == docs.count() and all(np.frombuffer(r.ids, np.uint32).tolist() == want[r.text] for r in rows)
        back = tree_bpe.decode(coded.withColumnRenamed("text", "was"), PATH, ("doc_id", "was")).collect()
        assert len(back) == len(rows) and all(r.text == (r.was or "") for r in back)
    assert tree_bpe.encode(empty, PATH).count() == 0


@pytest.mark.parametrize("length", [7, 2048])
def test_pieces_cover_everything_once_without_gaps(docs, empty, library, length):
    found = concat_pack.pack(docs, PATH, length=length).collect()
    sequences, texts = {}, {}
    for r in found:
        ids = np.frombuffer(r.ids, np.uint32)
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        texts.setdefault((r.sequence_id * length + r.offset - r.start), []).append((r.start, ids, r.doc_id, r.doc_tokens))
    total = sum(r.length for r in found)
    assert sorted(sequences) == list(range(-(-total // length)))
    for k, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or k == max(sequences)
    whole = sorted(((d, np.concatenate([x for _, x, _, _ in sorted(p, key=lambda y: y[0])]).tolist()) for p in texts.values() for d, t in [(p[0][2], p[0][3])]), key=repr)
    want = sorted(((r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()), key=repr)
    assert whole == want
    assert concat_pack.pack(empty, PATH).count() == 0
    assert make_texts()
