import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from assay.llm import id_planes
from assay.llm.common import shared_folder

TOKENIZER = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    encode = Tokenizer.from_file(TOKENIZER).encode
    return lambda text: [*encode(text or "", add_special_tokens=False).ids, 0]


def stored(docs, rows, **options):
    df = docs(rows)
    folder = shared_folder(df.sparkSession)
    id_planes.write_ids(df, folder, TOKENIZER, **options)
    return folder


def read(spark, folder):
    rows = id_planes.read_ids(spark, folder).collect()
    return sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [1, 7, 8, 1000, 65_537])
def test_planes_go_back_to_what_they_were(n, bits):
    values = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    data, sizes = id_planes.packed(values, bits)
    assert len(sizes) == (32 if bits else 4)
    back = id_planes.unpacked(memoryview(data), sizes, n, np.dtype("<u4"), bits)
    assert back.tolist() == values.tolist()


def test_small_ids_leave_high_planes_empty():
    _, sizes = id_planes.packed(np.random.default_rng(1).integers(0, 50_000, 1 << 16, dtype=np.uint32))
    assert max(sizes[2:]) < 50 < 10_000 < min(sizes[:2])


@pytest.mark.parametrize("bits", [False, True])
def test_documents_come_back_in_order_whatever_the_sizes_of_chunks_and_files(spark, docs, encode, bits):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "!", "über", "naïve", "x1"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    rng.shuffle(rows)
    want, start = [], 0
    for doc_id, text in sorted(rows):
        want.append((start, doc_id, encode(text)))
        start += len(want[-1][2])
    folder = stored(docs, rows, chunk_ids=37, file_ids=150, bits=bits)
    assert read(spark, folder) == want
    files = id_planes.manifest(spark, folder).orderBy("start").collect()
    assert len(files) > 20 and all(f.ids >= 150 for f in files[:1]) and sum(f.docs for f in files) == 200
    flat = [i for _, _, ids in want for i in ids]
    for first, last in ((0, 1), (100, 400), (333, 334), (start - 5, start), (0, start)):
        parts = sorted((r.start, r.ids) for r in id_planes.read_span(spark, folder, first, last).collect())
        assert parts[0][0] == first
        assert np.frombuffer(b"".join(p for _, p in parts), "<u4").tolist() == flat[first:last]


def test_nulls_empty_texts_repeats_and_long_texts(spark, docs, encode):
    long = "word! " * 60_000
    rows = [(3, "b"), (3, "a"), (3, "a"), (None, "x"), (None, None), (1, ""), (2, None), (9, long)]
    got = read(spark, stored(docs, rows, chunk_ids=1000))
    assert [d for _, d, _ in got] == [None, None, 1, 2, 3, 3, 3, 9]
    assert sorted(i for _, d, i in got if d is None) == sorted([encode("x"), [0]])
    assert got[2][2] == got[3][2] == [0]
    same = [i for _, d, i in got if d == 3]
    assert sorted(same) == sorted([encode("a"), encode("a"), encode("b")]) and same[1] in (same[0], same[2])
    assert got[-1][2] == encode(long)
    starts = np.cumsum([0, *(len(i) for _, _, i in got)])
    assert [s for s, _, _ in got] == starts[:-1].tolist()


def test_an_empty_table_gives_nothing(spark, docs):
    folder = stored(docs, [])
    assert read(spark, folder) == [] and id_planes.manifest(spark, folder).count() == 0


def test_damage_is_refused_by_name():
    file = id_planes.PlaneFile(0, 0, 50, False)
    for doc in range(10):
        file.add(doc, np.arange(30, dtype=np.uint32))
    data = file.done() + b"\0"
    assert sum(len(ids) for _, ids in id_planes.Opened("x", data).chunks()) == 300
    chunk = bytearray(data)
    chunk[12] ^= 1
    with pytest.raises(ValueError, match="damaged chunk 0: here"):
        list(id_planes.Opened("here", bytes(chunk)).chunks())
    index = bytearray(data)
    index[-id_planes.FOOTER.size - 5] ^= 1
    with pytest.raises(ValueError, match="damaged index: here"):
        id_planes.Opened("here", bytes(index))
    with pytest.raises(ValueError, match="damaged index: here"):
        id_planes.Opened("here", data[:-3])
    with pytest.raises(ValueError, match="not a file of id planes: here"):
        id_planes.Opened("here", data[2:])
