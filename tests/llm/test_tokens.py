import zlib

import numpy as np
import pytest

from medialoom.llm import token_frames as T
from medialoom.llm import viterbi_count as V
from medialoom.llm.shared import conf


def test_round_trip(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(T.tokenizer_path())
    where = f"file://{tmp_path}/out"
    T.write_frames(spark, docs, where, T.tokenizer_path())
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in T.read_frames(spark, where, with_ids=True).collect()), key=lambda r: r[1])
    want = sorted(((-1 if i is None else i, t or "") for i, t, *_ in rows))
    start = 0
    assert len(got) == len(want)
    for (i, t), g in zip(want, got, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert g == (i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids)
        start += len(ids)


def test_ids_of_hostile_strings_are_the_librarys():
    import random

    from tokenizers import Tokenizer

    tokenizer, coder, rng = Tokenizer.from_file(T.tokenizer_path()), T.Encoder(T.tokenizer_path()), random.Random(8)
    odd = ["\u1fbc\u0301", "A\u0301", "a\u030a", "\u00c5", "\u212b", "I\u0307", "\u0130", "\u0131", "\u01c5", "\u0149", "\u03a3", "\u03c2", "\u039f\u03a3", "\u1e9e", "\ufb01", "\u1100\u1161\u11a8", "\uac00\u11a8", "\u0f71\u0f72", "\u0344", "\u0340", "\u2126", "\u10a0", "\u13a0", "\u1c90", "\U00010400", "\u200d", "\u200b", "\ufeff", "\u0338", "\u0307", "\u0323"]
    space = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2000", "\u2001", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "  "]
    plain = ["the", "THE", "Caf\u00e9", "\u015eEHR\u0130.", "DEN\u0130ZL\u0130,", "don't", "I'LL", "end.", "end..,", "x,y", "'s", "12", "3.14", "<|", "<|endoftext|>", "<|EndOfText|>", "|>", "\u65e5\u672c", "\u0421\u041b\u041e\u0412\u041e.", "\u00aa.", "\u00df", "Stra\u00dfe,", ".", ","]
    texts = ["".join(rng.choice(rng.choice((odd, space, plain, plain, space))) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, coder.type).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_one_doc_id_fills_many_files(spark, tmp_path):
    rows = [(None if i % 2 else 5, f"text number {i} " * 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    with conf(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        files = T.write_frames(spark, docs, f"file://{tmp_path}/out", T.tokenizer_path())
    assert len(files) > 2 and max(f["docs"] for f in files) < 300
    got = sorted(T.read_frames(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 200 + [5] * 200


def test_reads_only_what_is_asked(spark, docs, tmp_path):
    where = f"file://{tmp_path}/out"
    files = T.write_frames(spark, docs, where, T.tokenizer_path())
    assert sorted(r.doc_id for r in T.read_frames(spark, where, [3, 400, 9999]).collect()) == [3, 400, 400]
    path = tmp_path / "out" / files[0]["file"]
    data = bytearray(path.read_bytes())
    data[20] ^= 255  # the first document's frame
    path.write_bytes(data)
    import pyarrow.fs as fs

    reader = T.FrameReader(fs.LocalFileSystem().open_input_file(str(path)))
    with pytest.raises(Exception, match="checksum|corrupt|descriptor|decompress|Unsupported|error"):
        reader.ids(0)
    assert len(reader.ids(len(reader.index) - 1))


def test_plain_readers_pass_over_the_tables(tmp_path):
    import io

    import zstandard

    class Keep(io.BytesIO):
        def close(self):
            pass

    out = Keep()
    w = T.FrameWriter(out, 2)
    w.add(1, b"ab" * 10)
    w.add(None, b"")
    w.close()
    reader = zstandard.ZstdDecompressor().stream_reader(out.getvalue(), read_across_frames=True)
    assert reader.read() == b"ab" * 10


def test_long_documents_take_several_frames(monkeypatch):
    import io

    import pyarrow as pa

    monkeypatch.setattr(T, "FRAME_TOKENS", 4)

    class Keep(io.BytesIO):
        def close(self):
            pass

    out = Keep()
    w = T.FrameWriter(out, 2)
    ids = np.arange(10, dtype="<u2")
    w.add(5, ids.tobytes())
    w.close()
    reader = T.FrameReader(pa.PythonFile(io.BytesIO(out.getvalue()), "r"))
    assert reader.index["frames"][0] == 3 and reader.ids(0).tolist() == ids.tolist()


def test_empty_table(spark, none):
    assert T.token_output(spark, none).count() == 0
    assert V.token_counts(spark, none).count() == 0


def test_counts_are_the_tokenizers(spark, docs, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown, stand_in = V.vocabulary(V.model_path())
    t = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=stand_in))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in V.token_counts(spark, docs).collect())
    assert got == sorted((-1 if i is None else i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows)


@pytest.mark.parametrize("bytes_stand_in", [False, True])
def test_ties_and_unknown_pieces(bytes_stand_in):
    import random

    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -3.0), ("bb", -2.5)]
    pieces += [(f"<0x{b:02X}>", -9.0) for b in range(256)] if bytes_stand_in else []
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=bytes_stand_in))
    c = V.Counter(pieces, 0, bytes_stand_in)
    rng = random.Random(1)
    for _ in range(400):
        w = "▁" + "".join(rng.choices("abcé", k=rng.randint(0, 9)))
        assert c.word(w) == len(t.encode(w, add_special_tokens=False).ids), w


def test_memory_of_chunks_is_bounded_and_keeps_frequent_ones():
    coder, asked = T.Encoder(T.tokenizer_path(), room=100), []
    learn = coder.learn
    coder.learn = lambda new: (asked.extend(new), learn(new))
    for k in range(40):
        coder.encode([f"often w{k}x " + " ".join(f"q{k}z{i}" for i in range(20))])
        assert len(coder.known) + len(coder.older) <= 100 + 2 * 22
    assert asked.count("often") == 1


def test_words_reach_the_tokenizer_many_at_once():
    import random

    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    coder = T.Encoder(T.tokenizer_path())
    plain, coder.tokenizer = coder.tokenizer, Counted(coder.tokenizer)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 12))) for _ in range(3000)]
    odd = ["X<|endoftext|>Y <|EndOfText|>", "don't!! can't** it's''s 's's a''s **", "a\vb\fc d\x1ce\x85f\u2003g \x00a", "\u2167 \u0130st \ufb01n** \u01c5.. \u02bcn \u00bd.. \u00aa!!", "x|y a<b>c <| |> word_ __x__ 12..", "", None, " \n "]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 3000, 100)] + odd
    got = coder.encode(texts)
    assert got == [np.asarray(plain.encode(t or "", add_special_tokens=False).ids, coder.type).tobytes() for t in texts]
    assert coder.tokenizer.texts < 100 and coder.encode([]) == []


def test_workers_give_back_the_memory_of_their_batches(spark, tmp_path):
    import random
    import re
    from pathlib import Path

    import pandas as pd

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(20_000)]
    rows = [(i, " ".join(rng.choices(words, k=3000))) for i in range(3000)]
    with conf(spark, **{"spark.sql.shuffle.partitions": "2", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}):
        T.write_frames(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), f"file://{tmp_path}/out", T.tokenizer_path())

    def held(frames):
        import ctypes

        import pyarrow as pa

        mb = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
        for _ in frames:
            before = mb()
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            yield pd.DataFrame({"mb": [before - mb()]})

    got = [r.mb for r in spark.range(0, 16, 1, 16).mapInPandas(held, "mb double").collect()]
    assert max(got) < 25, got
