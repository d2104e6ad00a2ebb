"""python -m tidemark.cli VERB --data DIR [--config FILE] [--out DIR]"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tidemark.config import load_config
from tidemark.pipeline import Pipeline
from tidemark.session import get_session

VERBS = ("fetch", "prepare", "backtest", "audit", "tune", "multiseed", "ablation", "ablation-significance", "info-gain", "full")


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("verb", choices=VERBS)
    a.add_argument("--data", required=True)
    a.add_argument("--config")
    a.add_argument("--out", default="out")
    o = a.parse_args(args)
    p = Pipeline(get_session(), o.data, load_config(o.config))
    match o.verb:
        case "fetch":
            frames = {k: v for k, v in p.tables().items()}
        case "prepare":
            frames = {"prepared": p.prepare().frame}
        case "audit":
            frames = {"audit": p.audit()}
        case "info-gain":
            frames = {"info_gain": p.info_gain()}
        case "ablation":
            frames = {"ablation": p.ablation()}
        case _:
            pred = p.backtest()
            frames = {"predictions": pred, "report": p.report(pred)}
            if o.verb in ("ablation-significance", "full"):
                frames["significance"] = p.significance(pred)
            if o.verb in ("multiseed", "full"):
                frames["multiseed"] = p.multiseed(pred)
            if o.verb in ("tune", "full"):
                frames["tune"] = pred.groupBy("alpha").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae"))
    p.save(frames, o.out)
    for k, v in frames.items():
        print(k, v.count())


if __name__ == "__main__":
    main()
