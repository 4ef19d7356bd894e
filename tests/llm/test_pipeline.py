import random

import corpus_pipeline
from tests.llm.cases import DOCS, prose
from tests.llm.test_decontaminate import expected as contamination
from tests.llm.test_quality import expected as statistics
from tests.llm.test_simhash import plain_fingerprint, roots
from tests.llm.test_suffix_dedup import expected as repeats


def test_against_plain_stages(spark, tmp_path):
    rng = random.Random(4)
    passage, item = prose(rng, 120, 5000), prose(rng, 40, 5000)
    texts = [None, "", "few words"] + [prose(rng, rng.randrange(30, 200), 5000) for _ in range(40)]
    texts += [texts[9], texts[10] + " more", texts[11] + passage, texts[12] + passage, texts[13] + " " + item]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = [(i, t) for i, t in enumerate(texts) if not statistics(t)[5]]
    fps = [plain_fingerprint(t) for _, t in docs]
    n = len(docs)
    keep = set(roots(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]))
    docs = [d for i, d in enumerate(docs) if i in keep]
    docs = [(i, r[4].decode("utf-8", "ignore")) for (i, _), r in zip(docs, repeats([t for _, t in docs], 400))]
    docs = [(i, t) for i, t in docs if not contamination(t, [(1, item)])[4]]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        words.setdefault(r.doc_id, []).extend(r.piece_text.encode().split())
    assert words == {i: t.encode().split() for i, t in docs}
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
