"""SentencePiece lattice against the library and an exact round trip."""
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from llm_tables import documents
from pyspark.sql import functions as F

from riskflow.llm import queries, sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_is_the_library_s_and_decodes_back(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    alphabet = ["a", "the", "tion", " ", "  ", "   ", "\n", "\t", "\r", "é", "中", "😀", "ゼ", "!", "...", "123", " ", "Hello", "zqxj", "́"]
    texts = [None, "", " ", "   ", "\n", "a", " a", "a ", "x" * 5000, "ab" * 40000, "e" * 64, "e" * 65, "same text", "same text", "▁b"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(300)]
    d = folder(documents=documents(texts))
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_sentence_pieces"](spark, d).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert rows[i]["n_tokens"] == len(want), t
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.asarray(want, dtype="<u4").tobytes()).hexdigest(), t
        assert rows[i]["exact"] == ("▁" not in (t or "")), t
    plain = sentence_pieces.encode(spark.read.parquet(d + "/documents.parquet"), PATH, ["doc_id"]).collect()
    assert all(np.frombuffer(r["ids"], dtype="<i4").tolist() == library.encode(texts[r["doc_id"]] or "") for r in plain)


def test_viterbi_takes_the_highest_sum(spark):
    model = sentence_pieces.pieces(PATH)
    rng = random.Random(2)
    words = [sentence_pieces.SPACE + "".join(rng.choices("abtheinos", k=rng.randint(1, 9))) for _ in range(60)] + ["中é", "x"]
    got = {r["word"]: r for r in sentence_pieces.encode_words(spark.createDataFrame([(w,) for w in set(words)], "word string"), spark, model, "viterbi").collect()}
    for w in words:
        best = [(0.0, 0)] + [None] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(j):
                hit = model.ids.get(w[i:j]) or ((None, sentence_pieces.UNKNOWN) if j == i + 1 else None)
                if hit and (best[j] is None or best[i][0] + hit[1] > best[j][0]):
                    best[j] = (best[i][0] + hit[1], best[i][1] + 1)
        assert len(got[w]["ids"]) == best[-1][1], w


def test_viterbi_takes_the_highest_sum_in_long_words(spark, folder):
    model = sentence_pieces.pieces(PATH)
    rng = random.Random(3)
    lengths = [5, sentence_pieces.LONG - 2, sentence_pieces.LONG - 1, sentence_pieces.LONG, sentence_pieces.LONG + 1, 90, 300]
    texts = ["".join(rng.choices("abtheinos", k=n)) for n in lengths for _ in range(3)]
    docs = spark.read.parquet(folder(documents=documents(texts)) + "/documents.parquet")
    rows = {f: {r["doc_id"]: np.frombuffer(r["ids"], dtype="<i4").tolist() for r in sentence_pieces.encode(docs, PATH, ["doc_id"], fold=f).collect()}
            for f in ("viterbi", "merges")}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for k, t in enumerate(texts):
        w = sentence_pieces.SPACE + t
        best = [0.0] + [None] * len(w)
        for j in range(1, len(w) + 1):
            best[j] = max(best[i] + model.ids[w[i:j]][1] for i in range(j) if w[i:j] in model.ids)
        scores = {i: s for _, i, s in model.table}
        assert abs(sum(scores[i] for i in rows["viterbi"][k]) - best[-1]) < 1e-6 and model.decode(np.array(rows["viterbi"][k], "<i4").tobytes()) == t
        assert rows["merges"][k] == library.encode(t)


def test_texts_are_looked_up_by_stretch(spark, folder, monkeypatch):
    """Stretches give the words of a whole text, at any spaces; a stretch that occurs again is not parted again."""
    model, rng = sentence_pieces.pieces(PATH), random.Random(3)
    texts = ["".join(rng.choices(" ▁\n,.aé漢b-'1x\t", k=rng.randint(0, 14))) for _ in range(20_000)] + ["", " ", "  ", sentence_pieces.SPACE, " a", "a ", "a  b"]
    for t in texts:
        whole = model.split.findall(" " + t.replace(sentence_pieces.SPACE, " ")) if t else []
        assert [w for s in model.stretches(t) for w in model.words(s)] == whole, t
        assert [a for s in model.stretches(t) for a in model.atoms(s)] == [a for w in whole for a in model.part.findall(w)], t
    made = []
    known = sentence_pieces.Remembered(lambda s: made.append(s) or s.encode())
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 3)
    assert b"".join(map(known.__getitem__, "a b a b a c a d a".split())) == b"ababacada" and made == ["a", "b", "c", "d", "a"]
    assert len(known) <= 3


def test_merges_take_a_batch_of_words_at_once(spark):
    """The fold of a whole Arrow batch is the fold of each word; only pieces of several characters are grouped."""
    model, rng = sentence_pieces.pieces(PATH), random.Random(4)
    words = ["".join(rng.choices("▁abtheinosréß中😀\x01", k=rng.choice([1, 2, 3, 7, 12, 30, sentence_pieces.LONG]))) for _ in range(400)]
    words = sorted({*words, "e", "中", "😀", "\x01", "e" * sentence_pieces.LONG, "▁" + "the" * 20})
    want = {w: model.fold(w.replace(sentence_pieces.SPACE, " ")) for w in words}
    rows = sentence_pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), spark, model)
    edges = sentence_pieces.merge_edges(rows).toArrow().combine_chunks()
    assert edges.column_names == ["word", "joins"] and sorted(edges["word"].to_pylist()) == words
    assert sum(map(len, edges["joins"].to_pylist())) == rows.filter("k > 1").count()
    for part in (edges, edges.slice(3, 100), edges.slice(0, 0)):
        word, joins = (part[c].combine_chunks() for c in ("word", "joins"))
        got = sentence_pieces.merge_fold(word, joins, model.singles)
        for w, ids in zip(word.to_pylist(), got.to_pylist(), strict=True):
            whole, pos = [], 0
            for i in ids:
                whole += [i] if i is not None else model.fallback(w[pos])
                pos += model.size[i] if i is not None else 1
            assert whole == want[w], w


def test_words_are_shuffled_once(spark, folder, capsys):
    """The splits of a word go along with its edges: what the fold returns is not shuffled or joined again."""
    model = sentence_pieces.pieces(PATH)
    pairs = spark.createDataFrame([("▁the", 0), ("▁the", 1), ("▁of", 1)], "word string, split int").repartition(3, "word")
    solved = sentence_pieces.encode_words(pairs.select("word").distinct(), spark, model, "merges", pairs.groupBy("word").agg(F.collect_list("split").alias("splits")))
    solved.explain()
    plan = capsys.readouterr().out
    assert plan.index("SortMergeJoin") > plan.index("ArrowEvalPython") and plan.count("Exchange hashpartitioning(word") == 2
    assert {r["word"]: (r["ids"], sorted(r["splits"])) for r in solved.collect()} == \
        {w: (model.fold(w), s) for w, s in (("▁the", [0, 1]), ("▁of", [1]))}
