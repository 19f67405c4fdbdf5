"""Recall of the n-gram Jaccard join, measured on pairs just above and just below its threshold."""

import random

from factloom.llm.jaccard_join import jaccard_join


def _shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def _pairs(n, low, high, draw):
    """``n`` pairs of texts of 40 to 400 words whose similarity is in [low, high)."""
    while n:
        words = draw.randint(40, 400)
        a = [f"w{draw.randrange(10**6)}" for _ in range(words)]
        b = list(a)
        for p in draw.sample(range(words), max(1, round((words - 4) * (1 - (low + high) / 2) / (1 + (low + high) / 2) / 5 + draw.random() - 0.5))):
            b[p] = f"v{draw.randrange(10**6)}"
        x, y = _shingles(a), _shingles(b)
        if low <= len(x & y) / len(x | y) < high:
            n -= 1
            yield " ".join(a), " ".join(b)


def test_pairs_at_the_threshold_are_found_and_pairs_below_it_are_not(spark):
    draw = random.Random(7)
    near, far = list(_pairs(500, 0.8, 0.83, draw)), list(_pairs(300, 0.77, 0.8, draw))
    texts = [t for pair in near + far for t in pair]
    rows = {r.doc_id: r for r in jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(rows[2 * k].n_text_links == 1 and rows[2 * k + 1].class_id == 2 * k for k in range(len(near)))
    assert found >= 0.995 * len(near)
    assert all(rows[k].n_links == 0 and rows[k].class_id == k for k in range(2 * len(near), len(texts)))


def test_a_class_larger_than_a_block_loses_no_link(spark):
    draw = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(1400):
        words = list(base)
        words[draw.randrange(120)] = f"v{k}"
        texts.append(" ".join(words))
    rows = jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [_shingles(t.split(" ")) for t in texts]
    for r in rows[::100]:
        links = sum(10 * len(sets[r.doc_id] & s) >= 8 * len(sets[r.doc_id] | s) for s in sets) - 1
        assert (r.class_id, r.n_text_links, r.n_links) == (0, links, links)
