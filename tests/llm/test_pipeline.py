"""The pipeline on planted documents, each stage against brute force on its own input."""

import importlib.util
import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest

from lamina.llm import mixing, quality
from lamina.llm.common import materialize

PIPELINE = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
pytestmark = pytest.mark.skipif(not PIPELINE.exists(), reason="no pipeline")


@pytest.fixture(scope="module")
def stages():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", PIPELINE)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def planted(spark, make, text, tmp_path_factory):
    rng = random.Random(12)
    clean = [text(rng, rng.randint(30, 200)) for _ in range(150)]
    junk = [" ".join(w + rng.choice(["$$$", "###", "!!"]) for w in text(rng, 60).split()) for _ in range(50)]
    items = [(i, text(rng, 30)) for i in range(5)]
    copies = [clean[3], clean[3], clean[4] + " one more word", clean[5].upper()]
    leaks = [text(rng, 50) + " " + items[k][1] + " " + text(rng, 50) for k in range(5)]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(clean + junk + copies + leaks)] + [(900, None, "a"), (901, "", None)]
    d = tmp_path_factory.mktemp("tables")
    make(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150)) for i in range(200)], "doc_id bigint, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items


def shingles(t):
    w = re.findall(r"[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_each_stage_against_its_own_input(spark, stages, planted):
    d, items = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in stages.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    runs = [f for _, f in stages.STAGES]

    before = docs.collect()
    docs = materialize(runs[0](spark, docs, d))
    kept = {r.doc_id for r in docs.collect()}
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert kept == {r.doc_id for r in before if quality.margin(quality.features((r.text or "").encode()), model) >= 0}
    assert len([i for i in kept if 150 <= i < 200]) <= 2 and len([i for i in kept if i < 150]) >= 147

    before = sorted(docs.collect(), key=lambda r: r.doc_id)
    docs = materialize(runs[1](spark, docs, d))
    sets, first = [shingles(r.text) for r in before], {}
    for i, r in enumerate(before):
        near = [j for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        first[r.doc_id] = min((first[before[j].doc_id] for j in near), default=r.doc_id)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(set(first.values()))

    before = docs.collect()
    docs = materialize(runs[2](spark, docs, d))
    windows = {" ".join(t.split()[k : k + 10]) for _, t in items for k in range(len(t.split()) - 9)}
    leaks = {r.doc_id for r in before if any(w in (r.text or "") for w in windows)}
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before} - leaks

    plan = mixing.taken_by_row(mixing.plan_mix(docs))
    want = Counter({r.doc_id: r.n_takes for r in plan.collect()})
    docs = materialize(runs[3](spark, docs, d))
    assert docs.columns == names
    assert Counter(r.doc_id for r in docs.collect()) == +want

    out = runs[4](spark, docs, d)
    rows = out.collect()
    assert out.columns == [*names, "shard", "slot"] and len(rows) == docs.count()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.get(i, 0) for i in range(40)) - min(sizes.get(i, 0) for i in range(40)) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, k) for s, n in sizes.items() for k in range(n))


def test_run(spark, stages, planted):
    rows = stages.run(spark, planted[0]).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{planted[0]}/documents.parquet").collect()}
    assert len(rows) > 100 and all(texts[r.doc_id] == r.text for r in rows)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert not {r.doc_id for r in rows} & {200, 201, 202, 203, *range(204, 209)}  # copies and leaks


def test_run_on_no_rows_and_on_clashing_columns(spark, stages, planted, make, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{planted[0]}/{name}.parquet").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
        spark.read.parquet(f"{planted[0]}/{name}.parquet").write.parquet(str(tmp_path / "wide" / f"{name}.parquet"))
    make([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert stages.run(spark, str(tmp_path / "none")).collect() == []
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{planted[0]}/documents.parquet").collect()]
    wide = make(docs, extra=True)
    wide.write.parquet(str(tmp_path / "wide" / "documents.parquet"))
    out = stages.run(spark, str(tmp_path / "wide"))
    assert out.columns == [*(c for c in wide.columns if c not in ("shard", "slot")), "shard", "slot"]
    plain = Counter(r.doc_id for r in stages.run(spark, planted[0]).collect())
    assert Counter(r.doc_id for r in out.collect()) == plain


def test_near_duplicates_at_the_threshold_beside_thousands_of_close_copies(spark, stages, make, crowded):
    rows, _ = crowded
    kept = sorted(r.doc_id for r in stages.near_duplicates(spark, make(rows), "").select("doc_id").collect())
    assert kept == [0, *range(2500, 2620, 2)]


def test_near_duplicates_count_their_tables_as_they_write_them(spark, stages, make, crowded, monkeypatch):
    """The driver's memory grows with the queries of a session: none is there only to count."""
    rows, _ = crowded
    calls, frame = Counter(), type(spark.range(0))
    for name in ("count", "isEmpty"):
        monkeypatch.setattr(frame, name, lambda self, name=name, f=getattr(frame, name): calls.update([name]) or f(self))
    kept = stages.near_duplicates(spark, make([*rows, rows[0], rows[2500]]), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, *range(2500, 2620, 2)]
    assert sum(calls.values()) <= 3


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="no /proc")
def test_written_tables_return_what_the_driver_has_freed(spark):
    """The stages write tables by the dozen; native memory that is freed meanwhile must not pile up in the driver."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1]) // 1024
    materialize(spark.range(1))
    held = jvm.java.util.Vector()
    for _ in range(2000):  # 125 MB in pieces that the C library takes from a thread's own pool
        held.add(jvm.java.nio.ByteBuffer.allocateDirect(1 << 16))
    last = jvm.java.nio.ByteBuffer.allocateDirect(1 << 16)  # above the others, so that these are a hole when freed
    high = resident()
    held.removeAllElements()
    for _ in range(3):
        jvm.java.lang.System.gc()
        time.sleep(0.5)
    materialize(spark.range(1))
    assert last.capacity() == 1 << 16 and resident() < high - 60
