"""Operators that judge documents, pages and conversations, against brute force."""
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from llm_tables import DOC, documents
from tokenizers import Tokenizer

from riskflow.llm import chat_trees, fingerprints, mixing, oracles, quality_rules, queries, token_counts, url_filters

ODD = [None, "", " \t\n", "a", "a b", "x " * 30000, "né 中文 <|endoftext|> don't\n\n\n  b\u00a0c\x1c\x85z", "same", "same", "  \n \n\nword  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, folder, library):
    rng = random.Random(1)
    alphabet = ["a", "e", "the", " ", "  ", "\n", "'s", "'", "ll", "1", "23", "é", "中", "😀", "!", "??", "<|endoftext|>", "\t", "\u3000", "\u00a0", "zqx", "tion"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)]
    d = folder(documents=documents(texts))
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_token_counts"](spark, d).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert rows[i]["n_tokens"] == want, t
        assert rows[i]["over_limit"] == (want > 1024) and rows[i]["n_bytes"] == len((t or "").encode())


def test_every_prefix_and_budget(library):
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    alphabet = ["he", "llo", " ", "  ", "\n", "'s", "'", "1", "é", "中", "!", "<|endoftext|>", "tion", "s"]
    for _ in range(60):
        t = "".join(rng.choices(alphabet, k=rng.randint(1, 14)))
        table = c.table(t)
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert [c.at(t, table, i) for i in range(len(t) + 1)] == want, t
        for budget in range(want[-1] + 1):
            assert c.cut(t, table, budget) == max(i for i, n in enumerate(want) if n <= budget), (t, budget)


@pytest.mark.parametrize("unit", ["ab", "中文é", " ", "\n\t", "!", "7"])
def test_a_budget_inside_a_long_pretoken_takes_one_pass(unit, monkeypatch):
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    passes, prefixes = [], c.prefixes
    monkeypatch.setattr(c, "prefixes", lambda word: passes.append(len(word)) or prefixes(word))
    for text in ("x " + unit * 60 + " y's", "x" + unit * 60 + "<|endoftext|>" + unit * 9):
        table = c.table(text)
        every = [c.at(text, table, i) for i in range(len(text) + 1)]
        for budget in (1, 2, 5, every[40], every[-1] - 3, every[-1] - 1):
            passes.clear()
            assert c.cut(text, table, budget) == max(i for i, n in enumerate(every) if n <= budget), budget
            assert len(passes) <= 12 + 5 * 13


def _measures(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, folder):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choices("ab cd ef gh #$ \n".split(" "), k=rng.randint(0, 60))) for _ in range(100)]
    texts += ["a b c d e f g h\n" * k for k in range(1, 6)]
    d = folder(documents=documents(texts))
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_quality_rules"](spark, d).collect()}
    for i, t in enumerate(texts):
        got = rows[i]
        assert tuple(got[m] for m in quality_rules.MEASURES) == _measures(t), t
        assert got["base_failed"] == (got["n_words"] < 20 or 100 * got["n_repeat_words"] > 30 * got["n_words"])
        assert not (got["base_failed"] and got["kept"])


def test_bad_host_is_judged_harder_and_clean_documents_stay(spark):
    clean = " ".join(f"clean{i}" for i in range(40))
    symbols = clean + " ### $$$"
    rows = [(i, "spam" * 1, "en", "bad", 1) for i in range(60)] + [(100, symbols, "en", "bad", 1), (101, clean, "en", "bad", 1)]
    rows += [(200 + i, clean + f" w{i}", "en", f"good{i % 7}", 1) for i in range(70)] + [(300, symbols, "en", "good1", 1), (301, clean, "en", None, 1)]
    for limit in (quality_rules.BROADCAST_HOSTS, -1):  # both ways to join the verdicts
        before, quality_rules.BROADCAST_HOSTS = quality_rules.BROADCAST_HOSTS, limit
        try:
            kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, DOC), ["doc_id"]).collect()}
        finally:
            quality_rules.BROADCAST_HOSTS = before
        assert not kept[100] and kept[101] and kept[300] and kept[301] and not kept[0]
        assert len(kept) == len(rows)


def test_empty_tables(spark, folder):
    d = folder(documents=([], DOC), pages=([], "page_id long, url string, html string"),
               labels=([], "doc_id long, quality int, toxic int"), conversations=([], "conv_id long, turn long, role string, text string"),
               benchmark=([], "item_id long, text string"))
    for name, f in queries.QUERIES.items():
        assert f(spark, d).count() == (1 if name.startswith("op6_") else 0), name


def test_targets_are_filled_to_the_cap(spark):
    sizes = {"a": 100, "b": 5, "c": 7000, None: 50, "d": 1, "e": 0}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "_source string, size long")
    got = {r["_source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, fixed = set(names), {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    want = fixed | share
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


def test_mix_meets_targets_and_reruns_agree(spark, folder):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(3000)]
    d = folder(documents=(rows, DOC))
    run = lambda: {r["doc_id"]: r for r in queries.QUERIES["op8_mixing"](spark, d).collect()}
    got = run()
    assert len(got) == len(rows)
    for s in ("a", "b", "c", None):
        mine = [got[r[0]] for r in rows if r[3] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 31
        assert all(r["taken"] <= 3 * r["size"] and r["source_size"] == sum(x["size"] for x in mine) for r in mine)
    assert {k: r["taken"] for k, r in run().items()} == {k: r["taken"] for k, r in got.items()}


def test_sketches_give_exact_differences():
    rng = random.Random(5)
    for n in (0, 1, 5, 60, 900):
        a = ". ".join(str(rng.random()) for _ in range(n))
        b = a[:len(a) // 2] + " new." * 3 + ". ".join(str(rng.random()) for _ in range(n // 3))
        left, right = fingerprints.difference(fingerprints.Sketch(a), fingerprints.Sketch(b))
        ka, kb = set(fingerprints.digests(a)), set(fingerprints.digests(b))
        assert set(left) == ka - kb and set(right) == kb - ka and len(left) == len(ka - kb)


def test_fingerprints_follow_the_order_of_ids(spark, folder):
    rng = random.Random(6)
    texts = ODD + [" ".join(f"w{rng.randint(0, 50)}." for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = documents(texts)[0]
    rng.shuffle(rows)
    d = folder(documents=(rows, DOC))
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_fingerprints"](spark, d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        e = t[:len(t) - k] + following[:k] if k else t
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[7]["near_next"] == 1.0


def test_reply_tree_branches(spark):
    nodes = [("t", 1, None, "user", "hi <|im_end|> <\\| <|", 1.0), ("t", 2, 1, "assistant", "best", 9.0), ("t", 3, 1, "assistant", "worse", 2.0),
             ("t", 4, 3, "user", None, 2.0), ("t", 5, 4, "assistant", "deep <|im_start|>", 2.0), ("u", 1, None, "assi\n\\stant", "x", None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    rows = {(r["tree"], r["rank"]): r for r in chat_trees.format_paths(df, top=0).collect()}
    assert set(rows) == {("t", 1), ("t", 2), ("u", 1)}
    assert chat_trees.read_back(rows["t", 1]["formatted"]) == [("user", "hi <|im_end|> <\\| <|"), ("assistant", "best")]
    deep = rows["t", 2]
    assert [t for _, t in chat_trees.read_back(deep["formatted"])] == ["hi <|im_end|> <\\| <|", "worse", "", "deep <|im_start|>"]
    assert chat_trees.loss_text(deep["formatted"], deep["loss"]) == "worsedeep <|im_start|>"
    assert chat_trees.read_back(rows["u", 1]["formatted"]) == [("assi\n\\stant", "x")]
    assert len(chat_trees.format_paths(df, top=1).collect()) == 2


def test_conversations(spark, folder):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", "x<|im_end|>\n"), (1, 2, "user", "x<|im_end|>\n"), (None, 0, None, "q"),
            (2, None, "assistant", "tail<"), (3, 5, "assistant", "<|im_end|><|im_start|>assistant ok")] + [(9, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(300)]
    d = folder(conversations=(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in queries.QUERIES["op6_chat_formatting"](spark, d).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        every = "".join(f"{r}\n{t}\n" for _, r, t in mine)
        loss = "".join(t for _, r, t in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine) and got[c]["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)


def test_url_templates_are_rejected_by_labels(spark):
    bad = [(i, f"http://Shop.Example.org/buy/{i}?x=1") for i in range(200)]
    good = [(1000 + i, f"https://shop.example.org/read/item-{i}.html#a") for i in range(200)]
    other = [(5000, None), (5001, "no-scheme/x"), (5002, "http://a.net/es/1"), (5003, "http://net/fr/"), (5004, "x://www.example.com/en/1"),
             (5005, "x://example.com/en/1"), (5006, "x://m.example.com/en"), (5007, "x://xnet/es/1"), (5008, "x://h?/a"), (5008, "x://h?/a")]
    pages = spark.createDataFrame(bad + good + other, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 1000) for i, _ in (bad + good)[::2]], "key long, bad boolean")
    rows = {r["page_id"]: r for r in url_filters.filter_urls(pages, labels, queries.URL_RULES).collect()}
    assert all(rows[i]["verdict"] == "block" and rows[i]["template"] == "/buy/*" for i, _ in bad)
    assert all(rows[i]["verdict"] == "allow" and rows[i]["template"] == "/read/*.html" for i, _ in good)
    assert rows[0]["host"] == "shop.example.org" and rows[0]["path"] == "/buy/0"
    assert [rows[5000 + i]["rule"] for i in range(9)] == [None, None, "net/es/", "net/fr/", "www.example.com/en/", "example.com/en/", "com/", None, None]
    assert (rows[5000]["host"], rows[5000]["path"], rows[5001]["host"], rows[5008]["path"]) == ("", "", "", "")


def _verdicts(spark, rows):
    """rows: (url, bad or None for no label) -> verdict and template by url."""
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows) if b is not None], "key long, bad boolean")
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, labels, []).collect()}
    assert len(got) == len(rows)
    return {u: (got[i]["verdict"], got[i]["template"]) for i, (u, _) in enumerate(rows)}


@pytest.mark.parametrize("prefix", ["", "/top/12"])
def test_url_siblings_are_merged_among_themselves_on_every_level(spark, prefix):
    section = lambda k, bad: [(f"x://h{prefix}/{'bg'[not bad]}{k % 7}{'' if k < 7 else 'abcdefg'[k // 7]}/{k}{i}", bad) for i in range(5)]
    rows = sum((section(k, False) for k in range(40)), []) + sum((section(k, True) for k in range(10)), [])
    got = _verdicts(spark, rows)
    assert all(got[u][0] == ("block" if bad else "allow") for u, bad in rows)


def test_recrawls_and_hot_children_do_not_stop_a_wildcard(spark):
    slug = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03}")
    many = [(f"x://copies/buy/{slug(i)}?v={k}", True) for i in range(60) for k in range(5)]
    hot = [(f"x://hot/buy/{slug(i)}", True) for i in range(200)] + [(f"x://hot/buy/index?v={k}", False) for k in range(600)]
    good = [(f"x://other/read/{i}", False) for i in range(600)]
    got = _verdicts(spark, many + hot + good)
    assert all(got[u] == ("block", "/buy/*") for u, _ in many + hot[:200])
    assert all(got[u] == ("allow", "/buy/index") for u, _ in hot[200:])


def test_deep_paths_are_read_to_the_end(spark):
    slug = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03}")
    rows = [(f"x://h/a/1/c/2/3/4/{w}/{slug(i)}/{i}.html", w == "bad") for w in ("bad", "good") for i in range(100)]
    rows += [("x://h/" + "/".join(map(str, range(30))) + "/x/", None), ("x://h/a/1/c/2/3/4/7/8", None)]
    got = _verdicts(spark, rows)
    assert all(got[u] == ("block" if bad else "allow", f"/a/*/c/*/*/*/{'bad' if bad else 'good'}/*/*.html") for u, bad in rows[:200])
    assert got[rows[200][0]][1] == "/*" * 30 + "/x/" and got[rows[201][0]][1] == "/a/*/c/*/*/*/*/*"


def test_sql(spark):
    import duckdb
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, d)
        cols = sorted(df.columns)
        got = Counter(tuple(r[c] for c in cols) for r in df.collect())
        assert got == Counter(con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()), name
    assert oracles.WORDS
