import random
import re

from perilgrid.llm.fingerprints import CONTENT
from perilgrid.llm.queries import QUERIES

RNG = random.Random(3)


def pieces(text):
    return set(re.findall(CONTENT, text))


def alike(a, b):
    a, b = pieces(a), pieces(b)
    return 1 - len(a ^ b) / (len(a) + len(b))


def test_texts_on_both_sides_of_a_size_border_stay_alike(spark, tmp_path):
    word = lambda: "".join(RNG.choices("abcdefghijklmnopqrstuvwxyzé😀", k=RNG.randrange(2, 9)))
    docs = []
    for k, border in enumerate((512, 4096, 32768)):
        text = " ".join(word() for _ in range(border))[: border + 40]
        docs += [(2 * k + 1, text), (2 * k, text[: border - 40])]
    docs += [(-1, "a\n\nbc d.  e\tfg \n" * 9), (-2, "x" * 500)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, str(tmp_path)).collect()}
    order = sorted(docs, reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        k = len(text) // 3
        assert abs(got[i].near_next - alike(text, following)) < 1e-9
        assert abs(got[i].near_edited - alike(text, text[: len(text) - k] + following[:k])) < 1e-9
    assert all(got[2 * k + 1].near_next > 0.8 for k in range(3))
