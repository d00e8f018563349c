"""Operators that work text by text: tokens, licenses, toxicity, packing."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from phasewise.llm import op1_sentencepiece as op1
from phasewise.llm import op6_packing as op6
from phasewise.llm import op9_toxicity as op9
from phasewise.llm import op10_license_scan as op10

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def mixed(seed: int, count: int, letters: str) -> list[str]:
    own = random.Random(seed)
    return ["".join(own.choice(letters) for _ in range(own.randint(0, 50))) for _ in range(count)]


ODD = ["", " ", "   ", "a" * 4000, " " * 700, "<s></s>", "<0x0A>", "�", "▁x▁▁", "don't we'll", "<|endoftext|> a",
       "漢字かな交じり文" * 30, "😀‍😀", "\x00\x01", "İſΣς é", "x" * 20 + "\n" * 30, "no spaces," * 300]


def awkward(spark, texts):
    """Rows with nulls, repeated rows, equal ids and columns with names used inside."""
    rows = [(k // 2 if k % 7 else None, t, "x", 1, "y") for k, t in enumerate(texts)]
    rows += [(1, None, None, None, None), (1, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, `_id` string, length int, `node` string").repartition(3)


def test_encoding_equals_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = op1.pieces(PIECES)
    texts = ODD + mixed(1, 3000, "  abcethros.,'\n\t▁é漢😀\x00‍012")
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == library.encode(text), text
        assert own.decode(ids) == library.decode(ids)
    draw = random.Random(2)
    for _ in range(3000):
        ids = [draw.choice((draw.randrange(32000), draw.randrange(259))) for _ in range(draw.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids)


def test_encoding_of_rows(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = awkward(spark, ODD)
    expected = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = library.encode(text or "")
        expected.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, op1.encode(docs, PIECES, digests=True).collect()), key=repr) == sorted(expected, key=repr)
    assert op1.encode(docs.limit(0), PIECES).collect() == []
    one = op1.encode(docs.where("text = '<s></s>'").limit(1), PIECES).first()
    assert list(one["ids"]) == library.encode("<s></s>") and one["decoded"] == "<s></s>"


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    own = op6.tokenizer(WORDS)
    for letters in ("  aBCethÉßsµ.,'\n\t é漢😀\x00‍0123<|ſİΣς", " aBCethÉßsµ.,\n\t é\x850123<²½ºªÀÿ×÷\xa0\x1c"):
        texts = ODD + mixed(3, 3000, letters)
        for ids, theirs in zip(own(texts), library.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == theirs.ids


def check_packing(rows, capacity):
    """Sequences are gapless from 0 and within the capacity."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    docs = awkward(spark, ODD)
    rows = op6.packed(docs, WORDS, capacity=64).collect()
    expected = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at:at + 64], "<u4")
            expected.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    check_packing(rows, 64)
    assert op6.packed(docs.limit(0), WORDS).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_rounds_are_best_fit_decreasing(seed):
    own = random.Random(seed)
    capacity = own.choice((7, 30, 100))
    lengths = sorted((own.randint(1, capacity) for _ in range(own.randint(1, 300))), reverse=True)
    gaps = []
    for length in lengths:
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    counts = {n: lengths.count(n) for n in set(lengths)}
    places = op6.rounds(counts, capacity)
    rows = [{"sequence_id": first + k, "offset": offset, "length": length}
            for length, _, count, first, offset in places for k in range(count)]
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert check_packing(rows, capacity) == len(gaps)


def test_pack_rejects_wrong_lengths(spark):
    with pytest.raises(ValueError):
        op6.pack(spark.createDataFrame([(1, 0)], "id int, length int"), 10)
    rows = op6.pack(spark.createDataFrame([(1, 4), (2, None), (2, 4), (2, 4)], "id int, length int"), 10).collect()
    assert sum(r["sequence_id"] is None for r in rows) == 1
    assert check_packing([r for r in rows if r["length"]], 10) == 2


NOTICES = [
    ("Released under teh MIT Licence.", "", "mit"), ("licensed under the apche licnse, version 2.0", "", "apache"),
    ("Licensed under CC BY-NC 4.0.", "", "cc-by-nc"), ("Permission is hereby granted, free of charge, to any persn obtaining a copy", "", "mit"),
    ("The MIT\nLicense and mit-license", "mit", "mit"), ("smit license, mit licenses", "", ""), ("nothing here", "", ""),
    ("GNU General Public License, version 3", "gpl", "gpl"), ("MIT License or Apache License", "apache,mit", "apache,mit"),
]


def test_licenses(spark):
    docs = awkward(spark, [t for t, _, _ in NOTICES] + ODD)
    rows = {r["text"]: r for r in docs.select("text").distinct().join(
        op10.scan(docs.select(F.col("text").alias("doc_id"), "text")).withColumnRenamed("doc_id", "text"), "text").collect()}
    for text, base, labels in NOTICES:
        assert (rows[text]["base_labels"], rows[text]["labels"]) == (base, labels), text
        assert (rows[text]["score"] == 1.0) == bool(base) or labels == "cc-by-nc"
    for text in ODD:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        assert rows[text]["n_words"] == len(words)
    assert len(op10.scan(docs).collect()) == docs.count()
    assert op10.scan(docs.limit(0)).collect() == []


def test_license_base_equals_brute_force(spark):
    own = random.Random(4)
    words = "mit license apache general public the MIT, License. x-mit".split()
    texts = [" ".join(own.choice(words) for _ in range(own.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in op10.scan(docs).collect():
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].lower())
        places = [k for phrase, _ in op10.PHRASES for k in range(len(found)) if found[k:k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(found), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))


def test_fuzzy_matches_equal_a_search_of_the_whole_text():
    import regex

    own = random.Random(7)
    search = op10.search(op10.NOTICES, op10.CHARS_PER_EDIT)
    for _ in range(150):
        notice, label = own.choice(op10.NOTICES)
        text = list(notice)
        for _ in range(own.randint(0, len(notice) // op10.CHARS_PER_EDIT + 2)):
            k = own.randrange(len(text))
            text[k:k + 1] = own.choice(([], ["q"], [text[k], "z"]))
        text = " aaa bbb " + "".join(text) + " ccc "
        edits = len(notice) // op10.CHARS_PER_EDIT
        whole = regex.search(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}", text)
        labels = {m[0] for m in search.matches(text)}
        assert not whole or label in labels or any(m[3] < sum(whole.fuzzy_counts) for m in search.matches(text))


def test_fuzzy_places_before_a_better_one_are_found():
    search = op10.search(op10.NOTICES, op10.CHARS_PER_EDIT)
    exact, worse = "gnu lesser general public license", "gnu leser general public licence"
    for lines in ([worse, exact], [exact, worse], [worse, worse, exact, worse], [worse, exact, worse, exact]):
        text = " " + " ".join(lines) + " "
        own = [(a, e) for label, a, _, e in search.matches(text) if label == "lgpl"]
        assert len(own) == len(lines) and sorted(e for _, e in own) == sorted(2 * (line == worse) for line in lines)


def test_kernel_table_equals_the_machine_on_landmarks():
    positive, negative = "idiot stupid loser moron".split(), "the of and house tree water stone river other".split()
    model = op9.word_model(positive, np.array([5.0, 4, 3, 2]), negative, 9)
    words = positive + negative + ["idxiot", "wat", "a" * 24]
    own = op9.features(words)
    gram = op9.kernel(own, own)
    assert np.allclose(gram, gram.T) and np.linalg.eigvalsh(gram).min() > -1e-9
    # a landmark expansion of the same function: solve for it on the examples and compare elsewhere
    assert (model.word_scores(positive) > 0).all() and (model.word_scores(negative) < 0).all()
    scores = model.word_scores(["iddiot", "stuupid", "xloser", "mo" + "oron", "grass"])
    assert (scores[:4] > scores[4]).all()
    assert op9.cleaned("i.d.i.o.t") == {"idiot"} and "idiot" in op9.chunks_of("you i d i o t").union(op9.chunks_of("i d i o t"))


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = op9.fit(docs, labels)
    rows = op9.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.03
    planted = ["What a fine day, and the " + w + " was there, said the other " + v for w, v in (
        ("idxiot", "stu-pid moron"), ("i.d.i.o.t", "loser"), ("sttupid", "worthlless clown"))]
    assert all(r["predicted"] for r in op9.score(spark.createDataFrame([(1, t) for t in planted], "doc_id int, text string"), model).collect())
    odd = awkward(spark, ODD)
    scored = op9.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    clashing = odd.withColumn("_score", F.lit("s"))
    assert op9.without_toxic(clashing, model).columns == clashing.columns
    assert {r["_score"] for r in op9.without_toxic(clashing, model).collect()} == {"s"}
    assert op9.score(odd.limit(0), model).collect() == []
    held = {r["doc_id"]: r["held_out"] for r in scored if r["doc_id"] is not None}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items())


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    assert len(op9.score(docs, op9.fit(docs, labels)).collect()) == 2


def test_many_places_are_counted_once(spark):
    """Word numbers of places count on from the place before, and equal those of a plain search."""
    text = "The MIT license, and the apache license. " * 3000 + "mit license general public license"
    (row,) = op10.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    words = [w.decode() for w in op10.words_of(text)]
    places = [k for phrase, _ in op10.PHRASES for n in [phrase.split()] for k in range(len(words)) if words[k:k + len(n)] == n]
    assert (row["n_base"], row["first_word"], row["last_word"]) == (len(places), min(places), max(places))
    for span in row["spans"]:
        assert 0 <= span["first_word"] <= span["last_word"] < len(words)
    joined = " " + " ".join(words) + " "
    for index, _ in op10.base_places(joined, op10.PHRASES)[::97]:
        assert index in set(places)
