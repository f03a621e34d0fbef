"""Scores of toxicity against a plain forward pass over the n-grams, and the pipeline's stage on toxic texts."""

import math
import random

import corpus_pipeline
from tidewell.llm import toxicity

WRAP = 1 << 64


def _mixed(x):
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % WRAP
    return x ^ (x >> 32)


def _word_score(word, model):
    s = model.settings
    marked = f"<{word.strip(toxicity.EDGES) or word}>"
    power = lambda j: pow(0x9E3779B97F4A7C15, j + 1, WRAP)
    found = [_mixed((k + sum((ord(c) + 1) * power(j) for j, c in enumerate(marked[a : a + k]))) % WRAP) for k in range(s.shortest, s.longest + 1) for a in range(len(marked) - k + 1)]
    found.append(_mixed(sum((ord(c) + 1) * power(j + 8) for j, c in enumerate(marked)) % WRAP))
    return sum(float(model.weights[h % s.buckets]) for h in found) / len(found)


def _score(text, model):
    s, words = model.settings, [_word_score(w, model) for w in toxicity.tokens(text)]
    n = max(1, len(words) // s.window)
    cuts = [k * len(words) // n for k in range(n)] + [len(words)]
    windows = sorted((sum(words[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:])), reverse=True) if words else []
    most = windows[: max(1, int(len(words) * s.share))]
    return 1 / (1 + math.exp(-(model.slope * ((sum(most) / len(most) if most else 0.0) + model.bias) + model.offset)))


def _texts(n):
    pick = random.Random(51)
    clean = ["morning", "river", "garden", "l'été", "walks,", "quietly", "(tea)", "42"]
    rows = []
    for k in range(n):
        words = [pick.choice(clean) for _ in range(pick.randint(3, 250 if k % 9 == 0 else 30))]
        if k % 4 == 0:
            words[pick.randrange(len(words))] = pick.choice(["grumblefool", "grumblefools!", "GrumbleF00l"])
        rows.append((k, " ".join(words), k % 4 == 0))
    return rows


def test_scores_equal_a_plain_forward_pass(spark):
    rows = _texts(120)
    model = toxicity.train([t for _, t, _ in rows], [int(y) for *_, y in rows], [k % 5 == 0 for k, *_ in rows])
    asked = [(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "..."), (903, "x" * 200 + "-grumblefool"), (904, "grumble fool é🙂")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for k, t in asked:
        want = _score(t, model)
        assert abs(got[k].score - want) < 1e-4 and (abs(want - 0.5) < 1e-3 or got[k].predicted == int(want >= 0.5))


def test_the_stage_drops_toxic_texts_and_keeps_clean_ones(spark, tmp_path):
    rows = _texts(400)
    spark.createDataFrame([(k, 0, int(y)) for k, _, y in rows if k < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(k, t, "en") for k, t, _ in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    toxic = {k for k, _, y in rows if y}
    left = {r.doc_id for r in kept}
    assert kept[0].__fields__ == docs.columns and len(left) == len(kept)
    assert len(left & toxic) <= 0.05 * len(toxic) and len(left - toxic) >= 0.98 * (len(rows) - len(toxic))
