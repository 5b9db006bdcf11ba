"""Command line for the configured jobs (the original's train / score / report programs).

    python -m auger.cli train   --config job.properties --data train.csv --algorithm GBM --out DIR [--threshold max_f1]
    python -m auger.cli score   --model DIR/model --config job.properties --data new.csv --out DIR2
    python -m auger.cli outliers --data emb.parquet --id vec_id --vector embedding --k 10 --top 5

Runs in the active Spark session (spark-submit) or a local one. Results are written by Spark
(CSV / JSON folders); only the small metric table is printed.
"""

from __future__ import annotations

import argparse
import json
import sys



def _config(args):
    from auger.sources.config import JobConfig
    text = open(args.config).read() if args.config else ""
    cfg = JobConfig.from_properties(text, args.data)
    if args.key:
        cfg = JobConfig(**{**cfg.__dict__, "key": args.key})
    return cfg


def cmd_train(spark, args) -> int:
    from auger.plans.train_report import train_from_config
    from auger.sources.models import save_model
    from auger.sources.tables import write_predictions
    thr = args.threshold
    if thr not in (None, "max_f1"):
        thr = float(thr)
    rep = train_from_config(spark, _config(args), args.algorithm, threshold=thr)
    for r in rep["metrics"].collect():  # a handful of rows
        print(json.dumps(r.asDict()))
    if args.out:
        write_predictions(rep["predictions"].select(
            "label", "prediction", *[c for c in rep["predictions"].columns if c[:1] == "p" and c[1:].isdigit()]),
            f"{args.out}/predictions")
        rep["confusion"].write.mode("overwrite").json(f"{args.out}/confusion")
        save_model(rep["pipeline"], f"{args.out}/model")
    return 0


def cmd_score(spark, args) -> int:
    from auger.operators.scoring import score
    from auger.sources.models import load_model
    from auger.sources.tables import read_scoring, write_predictions
    cfg = _config(args)
    pipe = load_model(args.model)  # cleaning is the training path's; the pipeline indexes and assembles
    last = pipe.stages[-1] if hasattr(pipe, "stages") else pipe.model
    out = score(pipe, read_scoring(spark, args.data, cfg), n_classes=getattr(last, "numClasses", None))
    write_predictions(out.drop("features", *[c for c in out.columns if c.endswith("_lvl")]), args.out)
    return 0


def cmd_outliers(spark, args) -> int:
    from auger.operators.neighbours import top_outliers
    df = spark.read.parquet(args.data) if args.data.endswith(".parquet") else spark.read.json(args.data)
    top = top_outliers(df, args.id, args.vector, args.k, args.top)
    for r in top.collect():  # a top-n report
        print(json.dumps(r.asDict()))
    return 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="auger")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--config")
    t.add_argument("--data", required=True)
    t.add_argument("--algorithm", default="GBM")
    t.add_argument("--key")
    t.add_argument("--threshold", help="max_f1 or a number (two classes); default: the learner's own")
    t.add_argument("--out")
    s = sub.add_parser("score")
    s.add_argument("--config", required=True)
    s.add_argument("--data", required=True)
    s.add_argument("--model", required=True)
    s.add_argument("--key")
    s.add_argument("--out", required=True)
    o = sub.add_parser("outliers")
    o.add_argument("--data", required=True)
    o.add_argument("--id", required=True)
    o.add_argument("--vector", required=True)
    o.add_argument("--k", type=int, default=10)
    o.add_argument("--top", type=int, default=5)
    args = ap.parse_args(argv)
    from auger.session import get_spark
    spark = get_spark()
    return {"train": cmd_train, "score": cmd_score, "outliers": cmd_outliers}[args.cmd](spark, args)


if __name__ == "__main__":
    sys.exit(main())
