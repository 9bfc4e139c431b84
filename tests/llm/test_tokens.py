import functools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from fixtures import frame, hard_rows
from tokenizers import Tokenizer

import __spark_entry__ as driver
from tasteloom.llm import packing, token_files, tokens

SMALL = "/root/testdata/sf0.001"
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def documents(folder):
    return duckdb.connect().execute(f"select doc_id, text from '{folder}/documents.parquet' order by 1").fetchall()


@functools.cache
def loaded(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def direct(name, texts):
    tokenizer = loaded(name)
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", FILES)
def test_words_have_the_ids_of_whole_texts(name, monkeypatch):
    r = random.Random(3)
    texts = [t for _, t in hard_rows()] + ["<|endoftext|> a <|startoftext|>", "first part <|endoftext|> second", "a<|endoftext|>b c", "x <|ENDOFTEXT|> <| y", "don't  I'LL\n'll 1234 77 a7b 7", "x" * 100 + " y"]
    for letters in ("ab 'st\n\tÉ 1!\x1c\x85　\xa0", "aB'st É1!7<|", "ab'é 17.\n", " \n a"):
        texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 20))) for _ in range(1500)]
    encode, kind = tokens.encoder(public_tokenizers.path(name))
    want = [np.array(i, dtype=kind).tobytes() for i in direct(name, texts)]
    assert encode(texts) == want
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)  # nothing more is remembered
    assert encode(texts) == want and encode([]) == []


def streams(rows, name):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for (i, _), ids in zip(order, direct(name, [t for _, t in order])):
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_file_query(spark):
    rows = driver.queries()["op3_token_id_output"](spark, SMALL).collect()
    assert sorted(tuple(r)[:4] for r in rows) == streams(documents(SMALL), FILES[0])


def test_token_files_of_hard_rows(hard, empty, tmp_path):
    manifest = token_files.write_token_files(hard, public_tokenizers.path(FILES[0]), f"file://{tmp_path}/t", length=16, sequences=4)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read_token_files(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == streams(hard_rows(), FILES[0])
    none = token_files.write_token_files(empty, public_tokenizers.path(FILES[0]), f"{tmp_path}/none")
    assert none.count() == 0 and token_files.read_token_files(none).count() == 0


def test_sequences_are_equally_long_and_masked(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"some words of document {k}") for k in range(40)], "doc_id long, text string").coalesce(1)
    manifest = token_files.write_token_files(docs, public_tokenizers.path(FILES[0]), str(tmp_path / "t"), length=32, sequences=3)
    row = manifest.collect()[0]
    file = token_files.TokenFile(row.ids_path)
    stream = np.concatenate([np.array(i) for i in direct(FILES[0], [f"some words of document {k}" for k in range(40)])])
    for number in range(-(-row.n_tokens // 32)):
        ids, mask = file.sequence(number)
        assert len(ids) == len(mask) == 32 and (ids[mask] == stream[number * 32:number * 32 + 32]).all()
    assert mask.sum() == (row.n_tokens - 1) % 32 + 1 and not ids[~mask].any()
    assert not ids.flags.owndata  # a view of the mapped file
    with pytest.raises(ValueError):
        file.span(int(row.n_tokens) - 1, 2)


def check_packing(rows, table, capacity):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for pieces in sequences.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    texts = dict(table)
    for (i, total), pieces in docs.items():
        ids = direct(FILES[1], [texts[i]])[0]
        end = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == end and r.ids_crc32 == crc(ids[end:end + r.length])
            end += r.length
        assert end == total == len(ids)
    return padding / sum(r.length for r in rows)


def test_packing_query(spark):
    rows = driver.queries()["op9_harmonic_packing"](spark, SMALL).collect()
    table = documents(SMALL)
    assert check_packing(rows, table, 4096) < 0.03 and {r.doc_id for r in rows} == {i for i, _ in table}


def test_packing_with_many_workers(spark):
    table = documents("/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, public_tokenizers.path(FILES[1]), capacity=512, small=16, pieces_per_worker=100).collect()
    assert check_packing(rows, table, 512) < 0.03


def test_packing_of_hard_rows(spark, hard, empty):
    single = [(i, t) for i, t in hard_rows() if i not in (None, 16, 17)]
    check_packing(packing.pack(frame(spark, single), public_tokenizers.path(FILES[1])).collect(), single, 4096)
    every = packing.pack(hard, public_tokenizers.path(FILES[1]), capacity=256, keep_ids=True)
    want = sum(len(i) for i in direct(FILES[1], [t for _, t in hard_rows()]))
    assert sum(r.length for r in every.collect()) == want
    made = packing.assemble(every, 256).collect()
    assert sum(r.n_tokens for r in made) == want
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 256) for r in made)
    assert packing.pack(empty, public_tokenizers.path(FILES[1])).count() == 0


def test_piece_lengths():
    for capacity, small in ((4096, 64), (100, 7), (8, 2)):
        for total in range(1, 3 * capacity):
            lengths = packing.piece_lengths(total, capacity, small)
            assert sum(lengths) == total and all(n <= small or n == capacity // (capacity // n) for n in lengths)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_letters_and_a_tail_take_the_model_alone(name, monkeypatch):
    """Normalizer and pre-tokenizer are most of the work for a new word; these words are one piece or two anyway."""
    import tokenizers
    from tasteloom.llm import tokens
    whole, sent = tokenizers.Tokenizer, []

    class Counting:
        @staticmethod
        def from_file(path):
            return Counting(whole.from_file(path))

        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, key):
            return getattr(self.inner, key)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(tokens, "_known", {})
    encode, kind = tokens.encoder(public_tokenizers.path(name))
    sent.clear()
    mixed = "9x " + " ".join(f"{'qz' * (n % 7)}Word{'abcdefghij'[n % 10] * (n % 5)}{[',', '.', '?!', chr(39), '...)', ''][n % 6]}" for n in range(500))
    plain = mixed + " é1 don't x-y ab" + chr(39) + "s 12,"
    found = encode([plain])[0]
    assert sum(map(len, sent)) < 100
    want = whole.from_file(public_tokenizers.path(name)).encode(plain, add_special_tokens=False).ids
    assert np.frombuffer(found, kind).tolist() == [*want, tokens.END_ID]
