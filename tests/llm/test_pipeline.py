"""Every stage of the pipeline against plain Python, or SQL, on what the stage before it kept."""

from collections import Counter, defaultdict

import duckdb
from test_near_dup import by_brute_force

import corpus_pipeline
from brightwell.llm import decontaminate, line_dedup, mixing, toxicity
from brightwell.llm.common import materialize


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    kept, given = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, given, sf), f"test-{name}")
        before = rows_of(given, "doc_id", "text", "source")
        if name != "mixing":
            assert out.columns == docs.columns
            kept[name] = rows_of(out, "doc_id", "text")
        if name == "toxicity":
            model = toxicity.fit(given, labels).state()
            score = toxicity.scores(model, [t for _, t, _ in before])
            assert kept[name] == [(d, t) for (d, t, _), s in zip(before, score, strict=True) if s < toxicity.THRESHOLD]
        elif name == "line_dedup":
            pages, carried = Counter(s for _, _, s in before), Counter()
            for _, t, s in before:
                carried.update((s, x) for x in {x.strip(" \t\r") for x in t.split("\n")} - {""})
            bad = {k for k, n in carried.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
            assert kept[name] == sorted((d, "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad)) for d, t, s in before)
        elif name == "near_dedup":
            group, first = by_brute_force([t for _, t, _ in before]), defaultdict(list)
            same = {}
            for k, ((d, t, _), g) in enumerate(zip(before, group, strict=True)):
                first[group[same.setdefault(t, k)] if t in same else g].append((d, t))
            # copies, which by_brute_force links only if they have words, are of the first one's group
            assert kept[name] == sorted(min(members) for members in first.values())
        elif name == "decontamination":
            match = decontaminate.Matcher([(r["item_id"], r["text"]) for r in items.collect()])
            assert kept[name] == [(d, t) for d, t, _ in before if not match(t)]
        else:
            given.write.parquet(str(tmp_path / "documents.parquet"))
            c = duckdb.connect()
            c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
            assert rows_of(out, "doc_id", "epoch") == sorted(c.execute(f"SELECT doc_id, epoch FROM ({mixing.OP1_SQL})").fetchall())
        given = out
    whole = corpus_pipeline.run(spark, sf)
    assert rows_of(whole, "doc_id", "epoch", "text") == rows_of(given, "doc_id", "epoch", "text")
