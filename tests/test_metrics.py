from datetime import datetime as T

from loomspar.plans import metrics


def test_split_metrics_take_every_spelling_and_each_item_once(spark, tmp_path):
    day = lambda n: T(2024, 1, n)
    rows = [
        (1, " Training", "CC", "ab-c", day(1)), (1, "train", "CC", "ABC", day(2)), (2, "TRAIN", "CN", "dd", day(1)), (3, "trn", "CC", None, day(1)), (4, "Val ", "CC", "x", day(1)), (5, "dev", "CO", "y", day(1)),
        (6, "Testing", " CN ", "A B C", day(1)), (6, "test", "CN", "abc", day(3)), (7, "test", "CF", "zz", day(1)), (8, "none", "CX", "dd", day(1)), (9, "test", " ", "--", day(1)), (None, "train", "CF", "zz", day(1)),
    ]
    df = spark.createDataFrame(rows, "item_id bigint, split string, ligand_smiles string, pocket_seq string, ingested_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "dataset_items.parquet"))
    run = lambda name: metrics.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.split: (r.uniqueness, r.novelty) for r in run("whole_uniqueness_novelty")} == {"train": (0.666666667, 0.0), "val": (1.0, 0.5), "test": (1.0, 0.5)}
    assert [tuple(r) for r in run("whole_precision_recall")] == [(1, 0.5, 0.5)]
