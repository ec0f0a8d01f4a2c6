"""Queries and parts of operators against plain versions of their contracts."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import host_rules, piece_bpe, queries, secrets, sorted_table, style_tree, suffix_radix, tiling

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_copies_of_a_run_lose_no_tile():
    block = tiling.ItemBlock([(1, "a b c a b c d e".split())], 5, 3)
    assert [c for _, c, _ in block.hits("a b c d e d e d e zzz a b c d e d e d e")] == [8]
    rng = random.Random(5)
    for _ in range(800):
        letters = rng.choice(("ab", "abcd", "abcdefgh"))
        item, text = [rng.choice(letters) for _ in range(rng.randint(5, 14))], []
        for _ in range(rng.randint(1, 14)):
            at = rng.randrange(len(item))
            text += item[at : at + rng.randint(1, 8)] * rng.randint(1, 3) + [rng.choice(["zzz", "zzz", "a"])]
        block = tiling.ItemBlock([(1, item)], 5, 3)
        whole = sum(n for *_, n in tiling.greedy_tiles(item, [w if w in item else None for w in text]))
        assert block._cover(0, np.array([block.vocabulary.get(w, -1) for w in text]))[0] == whole


@tables
def test_op1_on_whole_tables(spark):
    items = [(r["item_id"], tiling.tokens(r["text"] or "")) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {i: set(zip(w, w[1:], w[2:], strict=False)) for i, w in items}
    want = {}
    for d, t in texts(spark).items():
        words = tiling.tokens(t)
        own = set(zip(words, words[1:], words[2:], strict=False))
        fives = set(zip(*(words[k:] for k in range(5)), strict=False))
        for i, item in items:
            if item and own & grams[i]:
                vocabulary = set(item)
                covered = sum(n for *_, n in tiling.greedy_tiles(item, [w if w in vocabulary else None for w in words]))
                if covered / len(item) >= tiling.COVERAGE or fives & set(zip(*(item[k:] for k in range(5)), strict=False)):
                    want[d, i] = (covered, covered / len(item) >= tiling.COVERAGE)
    got = {(r["doc_id"], r["item_id"]): (r["n_covered"], r["contaminated"]) for r in queries.QUERIES["op1_string_tiling"](spark, SF).collect()}
    assert got == want and any(c for _, c in want.values())


def base_spans(text):
    """The three kinds by hand: no case folding beyond ASCII."""
    small = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text)
    out, value = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if small.startswith(word, at):
                p = at + len(word)
                p += p < len(text) and text[p] in "\"'"
                while p < len(text) and text[p] == " ":
                    p += 1
                if p < len(text) and text[p] in ":=":
                    p += 1
                    while p < len(text) and text[p] == " ":
                        p += 1
                    p += p < len(text) and text[p] in "\"'"
                    q = p
                    while q < len(text) and text[q] in value:
                        q += 1
                    if q > p:
                        if q - p >= 12:
                            out.append((at, 0, q))
                        at = q - 1
                        break
        at += 1
    for kind, head, letters, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            if text.startswith(head, at) and (head or text[at] in letters):
                q = at + len(head)
                while q < len(text) and text[q] in letters:
                    q += 1
                if q > at + len(head):
                    if q - at >= least:
                        out.append((at, kind, q))
                    at = q
                    continue
            at += 1
    return sorted(out)


@tables
def test_op2_base_spans(spark):
    known = texts(spark)
    for r in queries.QUERIES["op2_secret_scan"](spark, SF).collect():
        base = base_spans(known[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_secret_letters_are_ascii():
    assert secrets.find("pa\u017fsword=abcdefghijklmnop and to\u212aen: abcdefghijklmnop") == []
    assert [k for _, k, _ in secrets.find("PassWord=abcdefghijklmnop")] == [0]
    rng = random.Random(9)
    pieces = ["token=", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOPQR", " ", "x", "Zq8vN2xK9pLw4RtY7m", "'", ": ", "secret", "=="]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert [s for s in secrets.find(text) if s[1] < 3] == base_spans(text)


def test_secret_models_on_words_that_they_never_saw():
    fresh = [(t, y) for t, y in secrets.training(seed=99, size=4000, held=True) if len(t) >= secrets.MIN_RUN]
    hits = [(secrets.score(t) > max(secrets.IN_TOTAL, secrets.PER_CHAR * len(t)), y) for t, y in fresh]
    right, found, random_ones = sum(h and y for h, y in hits), sum(h for h, _ in hits), sum(y for _, y in hits)
    assert right / random_ones > 0.99 and right / found > 0.99
    assert {w[0] for w in secrets.words()} == set("abcdefghijklmnopqrstuvwxyz") and not set(secrets.words()) & set(secrets.words(True))


def test_encoders_on_odd_texts():
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = ["a", "b", "é", "ſ", "ÿ", "日本", " ", "  ", "\n", "\t", "'s", "'", "!", ",", "...", "12", "٣", " ", "<|endoftext|>", "Ā", "K", "\x00", "🙂", "İ", "ß", "'ll", "\r\n", "\x0b", "-", "%%%", "ж", "word", "The", "é"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "\n"]
    tokens = piece_bpe.read_ranks(piece_bpe.default_path())
    ranks = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    library = Tokenizer.from_file(P.path(sorted_table.VOCABULARY))
    for coder, plain in ((piece_bpe.codec(piece_bpe.default_path(), P.PATTERN), ranks.encode_ordinary), (sorted_table.encoder(P.path(sorted_table.VOCABULARY), P.PATTERN), lambda t: library.encode(t, add_special_tokens=False).ids)):
        for k in range(0, len(odd), 300):
            part = odd[k : k + 300]
            assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(pa.array(part))] == [plain(t) for t in part]


def test_a_small_cache_changes_nothing():
    import public_tokenizers as P

    rng, path = random.Random(4), P.path(sorted_table.VOCABULARY)
    lines = [" ".join("".join(rng.choice("abcdé,.") for _ in range(rng.randint(1, 5))) for _ in range(60)) for _ in range(40)]
    big, small = sorted_table.LibraryEncoder(path, P.PATTERN), sorted_table.LibraryEncoder(path, P.PATTERN)
    small.cache.limit, small.cache.units.limit = 3, 3
    for k in range(0, 40, 8):
        assert big.encode(pa.array(lines[k : k + 8])) == small.encode(pa.array(lines[k : k + 8]))


def test_radix_order_and_groups():
    rng = random.Random(6)
    for k in range(200):
        data = np.array([rng.choice([0, 97, 98, 255] if k % 2 else [97]) for _ in range(rng.randint(60, 300))], dtype=np.uint8)
        window = rng.choice([5, 8, 13, 24, 40])
        start = np.arange(len(data) - window)
        group = np.array([rng.randint(0, 3) for _ in start])
        key = lambda i: (int(group[i]), bytes(data[i : i + window]))  # noqa: E731, B023
        count = Counter(map(key, start))
        found = suffix_radix.radix_groups(data, start, group, window).tolist()
        assert sorted(found) == [i for i in start if count[key(i)] > 1]
        assert [key(i) for i in found] == sorted(key(i) for i in found)


@tables
def test_op8_on_whole_tables(spark):
    known, window, count = texts(spark), 400, Counter()
    for t in known.values():
        b = t.encode()
        count.update(hash(b[k : k + window]) for k in range(len(b) - window + 1))
    for r in queries.QUERIES["op8_suffix_radix"](spark, SF).collect():
        b = known[r["doc_id"]].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[hash(b[k : k + window])] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def plain_tree(pages):
    """Importance of every node of one host's pages, from the definitions."""
    styles, said, chains = defaultdict(Counter), defaultdict(Counter), {}
    for page in pages:
        seen, own = defaultdict(set), {}
        todo = [(style_tree.parse(page), ())]
        while todo:
            node, chain = todo.pop()
            chain = (*chain, node.path)
            kids = [p for p in node.parts if isinstance(p, style_tree.Node)]
            seen[node.path].add("|".join(k.label for k in kids))
            chains[node.path] = chain
            if text := style_tree.own_text(node):
                own[node.path, text] = len(text.split())
            todo += [(k, chain) for k in kids]
        for path, shapes in seen.items():
            styles[path][frozenset(shapes)] += 1
        said.update({})
        for (path, text), n in own.items():
            said[path][text, n] += 1
    m = {p: sum(c.values()) for p, c in styles.items()}
    log = lambda x, p: math.log(x) / math.log(m[p]) if m[p] > 1 else 0.0
    style = {p: -sum(n / m[p] * log(n / m[p], p) for n in c.values()) if m[p] > 1 else 1.0 for p, c in styles.items()}
    info = {p: sum(c * n * (1 - log(c, p)) for (_, n), c in said[p].items()) for p in styles}
    below = Counter()
    for p, chain in chains.items():
        for a in chain:
            below[a] += info[p]
    return {p: (m[p], 1 - (1 - style[p]) * (1 - below[p] / below[0]), max((style[a] for a in chains[p] if a != p), default=0.0)) for p in styles}


def site(rng, n):
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(k))
    pages, truth = [], []
    for i in range(n):
        title, body = words(5), [words(rng.randint(8, 40)) for _ in range(rng.randint(1, 9))]
        menu = "".join(f"<li><a>{words(1)}</a></li>" for _ in range(rng.randint(4, 6)))
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        pages.append(f"<body><div class=m><ul>{menu}</ul></div><div class=x>{words(9)}</div><div class=t><h1>{title}</h1>{paragraphs}<p>Read more stories here</p></div><div class=f>&copy; {words(8)}</div></body>")
        truth.append(" ".join([title, *body]))
    return pages, truth


def test_tree_without_markup(spark):
    """No element says what it is: the tree alone finds the article, and the
    line that all pages repeat inside it."""
    pages, truth = site(random.Random(3), 30)
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    observed = style_tree.observations(frame.withColumn("host", style_tree.host_of("url")))
    got = {r["node"]: (r["m"], r["importance"], r["free"]) for r in style_tree.importance(observed).collect()}
    want = plain_tree(pages)
    assert got.keys() == want.keys()
    for node, values in want.items():
        assert got[node] == pytest.approx(values, abs=1e-9)
    out = {r["page_id"]: r["text"] for r in style_tree.main_text(frame).collect()}
    assert [out[i] for i in range(30)] == truth
    off = {r["page_id"]: r["text"] for r in style_tree.main_text(frame, min_pages=1000).collect()}
    assert not any(off[i] == truth[i] for i in range(30))


def test_names_of_parts_of_articles_stay():
    page = '<article><div class="post-header"><h1>A</h1></div><div class="photo-rail">b</div><p>c <svg><text>d</text></svg></p><div class="discussion-body">e</div><div class="ad-box">x</div><section id="comments">y</section></article><div class="site-footer">z</div>'
    assert style_tree.extract(page) == "A b c d e"
    copies = frozenset({(n.path, style_tree._hash("A")) for n in [style_tree.parse("<article>A</article>").parts[0]]})
    assert style_tree.extract("<article>A</article>", frozenset(), copies) == "A"
    deep = "<div>" * 20_000 + "word" + "</div>" * 20_000
    assert style_tree.extract(deep) == "word" and max(map(len, style_tree.observe(deep)[2].values())) == style_tree.MAX_DEPTH + 1


def sql_rows(frame, name):
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    found = con.execute(queries.ORACLE_SQL[name]).df()
    return sorted(map(str, found[sorted(found)].astype(str).itertuples(index=False, name=None)))


def test_op9_rejects_a_host(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(300)] + [(1000 + i, bad if i % 10 else good, "poor") for i in range(200)] + [(2000 + i, good, f"s{i}") for i in range(9)] + [(3000, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mine = host_rules.quality_rules(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").toPandas()
    assert sorted(map(str, mine[sorted(mine)].astype(str).itertuples(index=False, name=None))) == sql_rows(frame, "op9_host_rules")
    assert mine[(mine["doc_id"] >= 1000) & (mine["doc_id"] < 1200)]["kept"].sum() == 0 < (~mine["base_failed"] & ~mine["kept"]).sum()


@tables
def test_op9_on_whole_tables(spark):
    mine = queries.QUERIES["op9_host_rules"](spark, SF).toPandas()
    assert sorted(map(str, mine[sorted(mine)].astype(str).itertuples(index=False, name=None))) == sql_rows(spark.read.parquet(f"{SF}/documents.parquet"), "op9_host_rules")
