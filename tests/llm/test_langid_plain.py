"""Operator 4 against a plain nearest-centroid classifier: n-grams in a dictionary, cosines one by one."""

import math
import re
from collections import Counter

from polyloci.llm import langid as G
from polyloci.llm.queries import op4_language_id, table

MASK = (1 << 64) - 1


def cell(gram):
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x100000001B3 + ord(c)) & MASK
    return ((h * (0x9E3779B97F4A7C15 + 2 * len(gram))) & MASK) >> 52


def grams(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    if not letters.strip(" "):
        return Counter()
    whole = " " + re.sub(" +", " ", letters) + " "
    return Counter(cell(whole[i : i + n]) for n in (1, 2, 3) for i in range(len(whole) - n + 1) if n > 1 or whole[i] != " ")


def plain(model, text):
    counts = grams(text)
    if not counts or not model.langs:
        return G.UNDETERMINED, 0.0, True
    x = {c: math.log1p(k) * float(model.idf[c]) for c, k in counts.items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    best = [(sum(v * float(centre[c]) for c, v in x.items()) / size, -i) for i, centre in enumerate(model.centroids)]
    cos, at = max(best)
    least = model.least[math.ceil(math.log2(len(counts) + 1))]
    return model.langs[model.owner[-at]], min(max(cos, 0.0), 1.0), cos < least


def check(rows, model, texts):
    near = 0
    for r in rows:
        lang, score, rejected = plain(model, texts[r["doc_id"]])
        assert abs(r["score"] - score) < 1e-4
        if r["lang_pred"] != lang or r["rejected"] != rejected:
            near += 1  # only where two centroids, or the threshold, are equally near to rounding
    assert near <= len(rows) // 100


def test_every_prediction_of_the_query_is_the_nearest_centroid(spark, small):
    docs = table(spark, small, "documents")
    model = G.fit(docs.filter(~G.held_out()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op4_language_id(spark, small).collect()
    assert len(rows) == len(texts) and len(model.langs) > 1
    check(rows, model, texts)


def test_odd_texts(spark, small):
    model = G.fit(table(spark, small, "documents"))
    texts = dict(enumerate([None, "", " \n", "123 ...", "a", "the the the", "Été naïve ÀÉ", "日本語", "İstanbul ǅ", "word " * 20_000, "x1y2z3", "den und die\nder"]))
    rows = G.predict_languages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    assert len(rows) == len(texts)
    check(rows, model, texts)


def test_document_frequencies_cover_all_rows(spark, small):
    docs = table(spark, small, "documents")
    model = G.fit(docs)
    own = [grams(r["text"]) for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text").collect()]
    n = Counter(c for g in own for c in g)
    assert all(abs(model.idf[c] - (math.log((1 + len(own)) / (1 + n[c])) + 1)) < 1e-4 for c in range(G.DIMS))
