"""A grid from one pass against one extraction for each configuration."""

import random
from itertools import product

from pyspark.sql import functions as F

from spanloom.operators import context, grid
from spanloom.operators.metrics import leaderboard
from spanloom.operators.select import without_overlap

SCHEMA = "row_idx long, found array<struct<start:int,end:int,category:string,canonical:string,score:double,match_type:string,is_trigger:boolean,filtered:boolean,gen:struct<a:int,b:int,c:int,d:bigint,e:bigint>,context:double,margin:double>>, gold array<struct<start:int,end:int,category:string>>"


def test_one_pass_equals_each_configuration_alone(spark):
    r, rows = random.Random(2), []
    for i in range(60):
        cs = [
            (a, a + r.randrange(1, 4), r.choice("xy"), "w", r.choice([0.75, 0.85, 1.0]), r.choice(["exact", "fuzzy", "regex"]), r.random() < 0.2, r.random() < 0.1,
             (0, 0, 0, 0, g), r.choice([None, 0.1, 0.4, 0.9]), r.choice([None, -0.2, 0.0, 0.3]))
            for g, a in enumerate(r.randrange(14) for _ in range(r.randrange(12)))
        ]
        gold = [(a, a + r.randrange(1, 3), r.choice("xy")) for a in range(0, 14, 4) if r.random() < 0.6]
        rows.append((i, cs, gold))
    rows += [(100, None, None), (101, [], [])]
    df = spark.createDataFrame(rows, SCHEMA)
    configs = [grid.Thresholds(*t) for t in product((0.0, 0.3), (0.0, 0.5), (0.2, 0.8), (None, 0.0), (0.0, 0.8))]
    got = {x.config_id: x for x in grid.board(df, configs).collect()}
    assert len(got) == len(configs) == 32
    flat = df.select("row_idx", F.inline("found"))
    gold = df.select("row_idx", F.inline("gold"))
    for i in (0, 5, 11, 22, 31):
        t = configs[i]
        kept = flat.where(context.context_allowed(t.exact, t.trigger, t.fuzzy)).where((F.col("match_type") != "fuzzy") | (F.col("score") >= t.cutoff))
        kept = kept.where(context.margin_allowed(t.margin)) if t.margin is not None else kept
        want = leaderboard(gold, {"one": without_overlap(kept.withColumn("other", F.lit(None).cast("double")))}).first()
        assert (round(got[i].precision, 9), round(got[i].recall, 9), round(got[i].f1, 9), got[i].support) == (round(want.precision, 9), round(want.recall, 9), round(want.f1, 9), want.support)
    assert len({(x.precision, x.recall) for x in got.values()}) > 8
