"""Recall of the embedding forest against all pairs: python tests/llm/forest_recall.py FOLDER

Compares the links of every vector, and the components, with those of all pairs of a label in
double precision, label by label in blocks.
"""

import os
import sys

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from cadenza.llm import forest  # noqa: E402


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.select("vec_id", "label", "embedding").toPandas()
    got = {r["vec_id"]: r for r in forest.near_duplicate_vectors(table).collect()}
    true, found, wrong, queries_true, queries_found = 0, 0, 0, 0, 0
    for label, part in rows.dropna(subset=["label", "embedding"]).groupby("label"):
        ids = part["vec_id"].to_numpy()
        x = np.array([list(map(lambda v: np.nan if v is None else float(v), e)) for e in part["embedding"]])
        size = np.linalg.norm(x, axis=1)
        ok = np.isfinite(size) & (size > 0)
        ids, x = ids[ok], x[ok] / size[ok, None]
        for lo in range(0, len(ids), 1000):
            links = (x[lo : lo + 1000] @ x.T >= forest.THRESHOLD).sum(axis=1) - 1
            own = np.array([got[i]["n_links"] for i in ids[lo : lo + 1000].tolist()])
            query = ids[lo : lo + 1000] % 50 == 0
            true, found, wrong = true + links.sum(), found + np.minimum(own, links).sum(), wrong + np.maximum(own - links, 0).sum()
            queries_true, queries_found = queries_true + links[query].sum(), queries_found + np.minimum(own, links)[query].sum()
    print(f"vectors {len(rows)}, links of all pairs {true // 2}, found {found // 2}, not links {wrong // 2}, recall {found / max(1, true):.6f}; of ids divisible by 50: {queries_found / max(1, queries_true):.6f}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
