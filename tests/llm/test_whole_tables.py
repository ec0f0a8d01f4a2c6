"""Cases that an operator's gate or rule used to lose."""

import random

from weftline.llm import secrets, set_sketch, tiling


def test_items_in_short_pieces_are_tiled():
    item = [f"w{i}" for i in range(30)]
    fifth = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(item))
    pieces = " x ".join(" ".join(item[i : i + 3]) for i in range(27, -1, -3))
    block = tiling.ItemBlock([(1, item), (2, [f"v{i}" for i in range(9)])], tiling.SEED_WORDS, tiling.MIN_MATCH)
    assert [(i, c) for i, c, _ in block.hits(fifth)] == [(1, 24)]
    assert [(i, c) for i, c, _ in block.hits(pieces)] == [(1, 30)]
    assert block.hits("w0 w1 w2 x w5 w6 w7") == []


def test_gate_keeps_all_that_tiling_accepts():
    rng = random.Random(11)
    for _ in range(300):
        item = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 24))]
        text = []
        for _ in range(12):
            at = rng.randrange(len(item))
            text += item[at : at + rng.randint(2, 5)] + [rng.choice("abcxyz")]
        found = tiling.ItemBlock([(1, item)], tiling.SEED_WORDS, tiling.MIN_MATCH).hits(" ".join(text))
        share = sum(n for _, _, n in tiling.greedy_tiles(item, [w if w in item else None for w in text])) / len(item)
        assert share < tiling.COVERAGE or found and found[0][2] >= tiling.COVERAGE


def test_rest_of_a_key_is_masked():
    key = "ghp_Zq8vN2xK9pLw4RtY7m0123456789abcdef"
    masked = secrets.mask(f"use {key} now", secrets.find(f"use {key} now"))
    assert "Zq8v" not in masked and "0123" not in masked and masked.startswith("use ") and masked.endswith(" now")
    path = "/user/repo/commit/0123456789abcdef0123456789abcdef"
    assert secrets.mask(path, secrets.find(path)) == "/user/repo/commit/<HEX>"
    assert [k for _, k, _ in secrets.find("key Zq8vN2xK9pLw4RtY7 of erschschberbertz")] == [3]


def test_own_text_under_a_shared_identifier_stays(spark):
    rng = random.Random(2)
    one, own = (" ".join(f"{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(1, one, "a"), (5, one, "b"), (5, own, "c"), (7, one, "d"), (None, one, "e")], "doc_id long, text string, mark string")
    assert sorted(r["mark"] for r in set_sketch.keep_one(docs).collect()) == ["a", "c", "e"]


def test_every_set_of_an_identifier_is_screened(spark):
    rng = random.Random(4)
    words = [f"{rng.randrange(10**6)}" for _ in range(60)]
    copy = " ".join([*words[:-1], "end"])
    for n in range(3):
        own = " ".join(f"{rng.randrange(10**6)}" for _ in range(400))
        docs = spark.createDataFrame([(5, own), (5, " ".join(words)), (9, copy)], "doc_id long, text string").repartition(n + 1)
        assert {r["doc_id"]: r["component_id"] for r in set_sketch.near_duplicates(docs).collect()} == {5: 5, 9: 5}
