"""The whole pipeline against plain Python on a small corpus: near copies by five words and a similarity of 0.8, repeats of 240 bytes."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from spindrift.llm.quality_rules import STOP_WORDS, SYMBOLS

STOP = {w for words in STOP_WORDS.values() for w in words.split()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def good(text):
    w = words(text)
    n = len(w)
    at = defaultdict(list)
    for k in range(n - 7):
        at[tuple(w[k : k + 8])].append(k)
    repeats = len({k + d for v in at.values() if len(v) > 1 for k in v for d in range(8)})
    lines = [x for x in (text or "").split("\n") if words(x)]
    ratio = lambda a, b: a * 1000 // max(b, 1)
    stop = sum(x.strip(".,;:!?()\"'").lower() in STOP for x in w)
    return (
        n >= 20 and 100 * repeats <= 30 * n and 2000 <= ratio(sum(map(len, w)), n) <= 12000
        and ratio(sum(c in SYMBOLS for c in text), n) <= 200 and ratio(stop, n) >= 20 and ratio(len(lines) - len(set(lines)), len(lines)) <= 500
    )


def similar(a, b):
    def shingles(text):
        w = [x.encode().lower() for x in words(text)]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def one_of_each(docs):
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if similar(docs[i][1], docs[j][1]):
                label[find(i)] = find(j)
    best = {}
    for k, d in enumerate(docs):
        best[find(k)] = min(best.get(find(k), d), d, key=lambda x: x[0])
    return list(best.values())


def without_repeats(docs, length=240):
    data = [d[1].encode() for d in docs]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for d, x in zip(docs, data, strict=True):
        keep = np.ones(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                keep[i : i + length] = False
        left = bytes(np.frombuffer(x, np.uint8)[keep]).decode("utf-8", "ignore")
        if words(left):
            out.append((d[0], left, d[2]))
    return out


def mixed(docs, cap=3):
    sizes = {d[0]: len(words(d[1])) for d in docs}
    sources = sorted({d[2] for d in docs if d[2] is not None}, key=str.encode) + [None] * any(d[2] is None for d in docs)
    per = {s: sum(sizes[d[0]] for d in docs if d[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    full, total = set(), sum(per.values())
    while True:
        share = (total - sum(cap * per[s] for s in full)) / max(1, sum(weight[s] for s in sources if s not in full))
        over = {s for s in sources if s not in full and share * weight[s] > cap * per[s]}
        if not over:
            break
        full |= over
    out = []
    for s in sources:
        target = cap * per[s] if s in full else share * weight[s]
        whole = int(target // per[s])
        need, run = target - whole * per[s], 0
        for d in sorted((d for d in docs if d[2] == s), key=lambda d: int(hashlib.md5(f"7:{d[0]}".encode()).hexdigest()[:15], 16)):
            extra = need > 0 and run + sizes[d[0]] / 2 <= need
            run += sizes[d[0]]
            out += [d] * (whole + extra)
    return out


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    stop = sorted(STOP)
    word = lambda: rnd.choice(stop) if rnd.random() < 0.3 else "".join(rnd.choices("abcdefghéü", k=rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(120)
    texts = [prose(rnd.randint(25, 300)) for _ in range(60)]
    for k in range(8):
        texts.append(f"{prose(40 + k)} {passage} {prose(30)}")
        near = texts[k].split(" ")
        near[rnd.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], passage, None, "", "too short", "# $ | " * 60, "a b c d e f g h " * 20, "é" * 900]
    docs = [(k, t, rnd.choice(["a", "b", "B", None, "z"]), "x") for k, t in enumerate(texts)]
    rows = [(k, t, lang, s, len(t or "")) for k, t, s, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = mixed(without_repeats(one_of_each([d[:3] for d in docs if good(d[1])])))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(d[0], d[2], len(ids := library.encode_ordinary(d[1])), sha(np.array(ids, "<u4").tobytes()), sha(d[1].encode())) for d in want]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, ((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got))) == sorted(map(key, rows))
    assert 40 < len({r.doc_id for r in got}) < len(docs) - 10


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 3 + "x y z of " * 5, "en", "s", 0), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            assert stage(spark, some, "").columns == docs.columns
            assert stage(spark, some, "").count() <= 3
