"""Near copies of five-word similarity 0.8 against brute force."""

import random

import corpus_pipeline
from spindrift.llm import shingle_links


def similar(a, b):
    def sets(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    a, b = sets(a), sets(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_roots(texts):
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(3, 7)))
    texts = ["", None, " \n", "one two", "One TWO", "one two three"]
    for n in (30, 60, 60, 100, 200, 400, 1500):
        words = [word() for _ in range(n)]
        texts.append(" ".join(words))
        for copy in range(8):
            near = list(words)
            # From a word in a hundred to more than 0.8 allows.
            for _ in range(max(1, n * copy // 200)):
                near[rnd.randrange(n)] = word()
            texts.append(" ".join(near))
    # A chain whose ends aren't similar, and a long text that has a short one inside.
    words = [word() for _ in range(100)]
    texts += [" ".join(words[k:]) for k in range(0, 50, 8)] + [texts[6] + " " + texts[20]] + [texts[10]] * 3
    return texts


def test_reach():
    texts = corpus()
    roots = brute_roots(texts)
    assert shingle_links.reach([shingle_links.shingles(t) for t in texts]).tolist() == roots
    assert 20 < len(set(roots)) < len(texts) - 20


def test_stage_keeps_one_of_each_component(spark):
    texts = corpus()
    ids = list(range(100, 100 + len(texts)))
    random.Random(5).shuffle(ids)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    best = {}
    for i, r in zip(ids, brute_roots(texts), strict=True):
        best[r] = min(i, best.get(r, i))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(best.values())
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
