"""Feature files with their dirty cases, class files and the command line."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.__main__ import arguments, build, run
from kindred.functions import ids
from kindred.sources import catalogue, feature_files as files, growing_store, tables


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("f, value, want", [
    (ids.normalise, "music/Rock & Pop/A.B, c; d.mp3", "music/Rock&Pop/ABcdmp3"),
    (lambda c: ids.normalise(c, brackets=True), "a[1].mp3", "a1mp3"),
    (ids.unwrap_bytes, "b'Rock/Queen - x.mp3'", "Rock/Queen - x.mp3"),
    (ids.unwrap_bytes, "plain", "plain"),
    (ids.strip_path, "a/b/c.wav", "c.wav"),
    (ids.strip_extension, "a.b/c.d.wav", "a.b/c.d"),
    (ids.strip_extension, "a.b/.hidden", "a.b/.hidden"),
    (ids.strip_extension, "a.b/c", "a.b/c"),
    (ids.class_from_path, "music/Pop/x.mp3", "Pop"),
    (lambda c: ids.strip_prefixes(c, ["/data/a/", "/data/b.c/"]), "/data/b.c/x/data/a/y", "xy"),
    (lambda c: ids.match_key(c, lower=True), "Pop/Song.MP3", "song"),
])
def test_ids(spark, f, value, want):
    assert column(spark, value, f) == want


def test_vectors(spark):
    parsed = files.parse_vectors(lines(spark, "a b.mp3,1.5, 2.0", "b'c.mp3',b'3',b'-4e-2'", "broken", "x,1,oops"), "v")
    assert {(r.id, tuple(r.v)) for r in files.accepted(parsed, "v").collect()} == {("abmp3", (1.5, 2.0)), ("cmp3", (3.0, -0.04))}
    assert parsed.count() == 4


def test_beats_and_notes(spark):
    beat = files.parse_beats(lines(spark, "a, b.mp3; 116.27; [0.0,  1.5, 2]")).first()
    assert (beat.id, beat.bpm, beat.bh) == ("abmp3", 116.27, [0.0, 1.5, 2.0])
    note = files.parse_notes(lines(spark, "a.mp3; G#; minor; [0, 1, 10, 11, 2, 9]")).first()
    assert (note.id, note.key, note.scale, note.notes) == ("amp3", "G#", "minor", "ABKLCJ")
    assert files.accepted(files.parse_beats(lines(spark, "no delimiters")), "bh").count() == 0
    bad = files.parse_notes(lines(spark, *[f"a.mp3; G; minor; {x}" for x in ("[1, 12]", "[x]", "[-1]", "[1.5]", "[]", "")]))
    assert [r.notes for r in bad.collect()] == [None] * 6


@pytest.mark.parametrize("extension", ids.EXTENSIONS)
def test_records_end_ids_at_the_extension(spark, extension):
    row = files.parse_records(lines(spark, f"mu sic/a;b, c.{extension}; [1, 2]; [[3]]")).first()
    assert row.id == f"music/abc{extension}" and row.body == "[1,2];[[3]]"


def test_gaussians(spark):
    mean, cov = list(range(13)), list(range(169))
    text = f"x.mp3; {mean}; {np.reshape(cov, (13, 13)).tolist()}"
    row = files.parse_gaussians(lines(spark, text, text.replace("; [[", ", [["))).collect()[1]
    assert row.mean == [float(x) for x in mean] and row["cov"] == [float(x) for x in cov]
    assert len(files.parse_compact_timbre(lines(spark, "x.mp3; [1, 2]; [3]; [4, 5]")).first().mfcc) == 5


def test_malformed_chroma_goes_to_the_rejects(spark):
    good, bad = files.parse_chroma(lines(spark, f"a.mp3; [[0.1, 0.2], [1.0, 0.0]{', [0, 1]' * 10}]", "e.mp3; [[0.1, 0.2], [1.0, 0.0]]", "b.mp3; []", "c.mp3; [[2.0]]", "d; [[0.1]]"))
    assert [(r.id, r.chroma) for r in good.collect()] == [("amp3", [0.1, 0.2, 1.0, 0.0] + [0.0, 1.0] * 10)]
    assert {r.id for r in bad.collect()} == {"emp3", "bmp3", "cmp3", ""}


def test_compaction_and_the_partition_hint_need_no_shuffle(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(40):
        (tmp_path / "in" / f"out{i}.rh").write_text("".join(f"{i},{j}\n" for j in range(400)))
    (tmp_path / "in" / "out99.rh").write_text("".join(f"99,{j}\n" for j in range(20_000)))
    before = {k: spark.conf.get(f"spark.sql.files.{k}", None) for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")}
    sizes = [p.stat().st_size for p in (tmp_path / "in").iterdir()]
    tables.compact(spark, str(tmp_path / "in" / "*.rh"), str(tmp_path / "out"), file_bytes=16_000)
    written = [p.stat().st_size for p in (tmp_path / "out").glob("part-*")]
    assert sum(written) == sum(sizes) and max(written) <= 16_100 and len(written) <= 2 * sum(sizes) / 16_000
    assert before == {k: spark.conf.get(f"spark.sql.files.{k}", None) for k in before}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(
        [f"{i},{j}" for i in range(40) for j in range(400)] + [f"99,{j}" for j in range(20_000)]
    )
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    n = files.read_lines(spark, str(tmp_path / "out")).rdd.getNumPartitions()
    assert "Exchange" not in plan(files.read_lines(spark, str(tmp_path / "out"), n))
    more = files.read_lines(spark, str(tmp_path / "out"), n + 5)
    assert "Exchange" in plan(more) and more.rdd.getNumPartitions() == n + 5


def test_query_list(spark):
    got = files.parse_query_list(lines(spark, "music/A b.mp3     :       3", "music/c.mp3"))
    assert [r.id for r in got.collect()] == ["music/Abmp3", "music/cmp3"]


def test_inventory_sizes(spark):
    paths = spark.range(103).select(F.format_string("p%03d", "id").alias("path"))
    shards = catalogue.inventory(paths).groupBy("shard").count().collect()
    # 103 paths: 5 parts, 21 paths each
    assert sorted((r["shard"], r["count"]) for r in shards) == [(0, 21), (1, 21), (2, 21), (3, 21), (4, 19)]
    line = catalogue.file_list_lines(spark.createDataFrame([("a.mp3", 2)], "path string, shard int")).first().value
    assert line == "a.mp3     :       2"


def test_list_files(spark, tmp_path):
    for name in ("x/a.mp3", "x/y/b.mp3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    assert catalogue.list_files(spark, str(tmp_path)).count() == 2


def test_label_table_refuses_other_entries(spark, tmp_path):
    (tmp_path / "labels.tsv").write_text("id\trock\tpop\na\tx\t\nb\t\t?\n")
    read = tables.read_label_table(spark, str(tmp_path / "labels.tsv"), ["rock", "pop"])
    with pytest.raises(Exception, match="unrecognised entry in column pop"):
        read.collect()
    raw = spark.createDataFrame([("a", "x", None), ("b", None, "?")], "id string, rock string, pop string")
    assert tables.wrong_label_entries(raw, ["rock", "pop"]).first().asDict() == {"rock": 0, "pop": 1}


def test_result_header_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id int, d double")
    tables.write_results(df, str(tmp_path / "r"), by_query=False)
    assert tables.read_results(spark, str(tmp_path / "r"), "id int, d double").first().d == 0.5
    with pytest.raises(Exception):
        tables.read_results(spark, str(tmp_path / "r"), "id int, other double").collect()


def test_features_append_and_second_id(spark, tmp_path):
    df = spark.createDataFrame([("rh", "a", [1.0]), ("rp", "a", [2.0])], "feature string, id string, values array<double>")
    tables.write_features(df, str(tmp_path / "f"))
    tables.write_features(df.withColumn("id2", F.lit("z")), str(tmp_path / "g"))
    both = tables.read_features(spark, [str(tmp_path / "f"), str(tmp_path / "g")], "rh").collect()
    assert sorted((r.id, r.id2 or "", tuple(r["values"])) for r in both) == [("a", "", (1.0,)), ("a", "z", (1.0,))]


def test_corrections_and_subset(spark):
    rows = spark.createDataFrame([("a;b", 1), ("c", 2)], "id string, n int")
    fixes = spark.createDataFrame([("a;b", "ab")], "wrong string, right string")
    assert sorted(map(tuple, catalogue.correct_ids(rows, fixes).collect())) == [("ab", 1), ("c", 2)]
    assert sorted(r.id for r in catalogue.first_n(spark.range(30), 7).collect()) == list(range(7))


@pytest.fixture(scope="module")
def songs(tmp_path_factory):
    """Six songs in two feature folders, one with empty chroma."""
    root, rng = tmp_path_factory.mktemp("songs"), np.random.default_rng(5)
    for folder in (0, 1):
        out = {e: [] for e in ("rp", "rh", "bh", "notes", "chroma", "mfcckl")}
        for i in range(3):
            name = f"music/Class {folder}/Song {i}, no. {folder}.mp3"
            plain = name.replace(",", "")
            a = rng.normal(size=(13, 13))
            cov = (a @ a.T + np.eye(13)).tolist()
            out["rp"].append(",".join([plain, *map(str, rng.random(1440))]))
            out["rh"].append(",".join([plain, *map(str, rng.random(60))]))
            out["bh"].append(f"{name}; {100 + i}.5; {rng.random(250).tolist()}")
            out["notes"].append(f"{name}; C#; major; {rng.integers(0, 12, 40).tolist()}")
            out["mfcckl"].append(f"{name}; {rng.normal(size=13).tolist()}; {cov}")
            out["chroma"].append(f"{name}; " + ("[]" if (folder, i) == (1, 2) else str(rng.random((12, 50 + 9 * i)).tolist())))
        (root / f"features{folder}").mkdir()
        for e, text in out.items():
            (root / f"features{folder}" / f"out0.{e}").write_text("\n".join(text) + "\n")
    return str(root)


@pytest.mark.parametrize("strategy", ["gathered", "separate", "prefilter"])
def test_command_line(spark, songs, strategy):
    song = "music/Class 0/Song 1, no. 0.mp3"
    got = run(spark, arguments([song, "--root", songs, "--strategy", strategy])).collect()
    assert len(got) == 5 and got[0].id == "music/Class0/Song1no0mp3" and got[0].aggregated == pytest.approx(0, abs=1e-9)
    assert (got[0]["key"], got[0]["scale"], got[0]["bpm"]) == ("C#", "major", 101.5)


def test_command_line_options(spark, songs):
    song = "music/Class 0/Song 1, no. 0.mp3"
    assert run(spark, arguments([song, "--root", songs, "--features", "js+rp", "--top", "2"])).count() == 2
    assert "scaled_mfcc" in run(spark, arguments([song, "--root", songs, "--features", "mfcc"])).columns
    assert run(spark, arguments([song, "--root", songs, "--strategy", "refine"])).count() <= 5


def test_a_stored_catalogue_gives_the_same_answers(spark, songs, tmp_path):
    song, store = "music/Class 0/Song 1, no. 0.mp3", str(tmp_path / "store")
    build(spark, arguments(["build", "--root", songs, "--store", store]))
    assert [(r.file_type, r.id, r.reason) for r in spark.read.parquet(store + "-rejects").collect()] == [("chroma", "music/Class1/Song2no1mp3", "bad values")]
    for extra in ([], ["--strategy", "prefilter", "--top", "2"], ["--strategy", "refine", "--features", "bh+rh"], ["--strategy", "lsh"]):
        from_files = [r.id for r in run(spark, arguments([song, "--root", songs, *extra])).collect()]
        stored = [r.id for r in run(spark, arguments([song, "--store", store, *extra])).collect()]
        assert stored == from_files and len(stored) == (2 if "--top" in extra else len(stored))


def test_a_store_grows_by_new_files_only(spark, songs, tmp_path):
    root, store = tmp_path / "songs", str(tmp_path / "store")
    shutil.copytree(f"{songs}/features0", root / "features0")
    first = growing_store.extend(spark, str(root), store)
    assert (first.items, first.unique, first.dimensions["rp"], first.rows.count()) == (3, True, 1440, 3)
    before = sorted(p.name for p in (tmp_path / "store").iterdir())
    assert growing_store.extend(spark, str(root), store).items == 3  # no new file, nothing written
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == before
    shutil.copytree(f"{songs}/features1", root / "features1", ignore=shutil.ignore_patterns("*.bh"))
    assert growing_store.extend(spark, str(root), store).items == 3  # nothing is complete without bh
    # A build that was cut off leaves a version without facts; the next one writes over it.
    shutil.copytree(tmp_path / "store/version=1", tmp_path / "store/version=3")
    shutil.copy(f"{songs}/features1/out0.bh", root / "features1" / "out0.bh")
    grown = growing_store.extend(spark, str(root), store)
    assert grown.items == 5 and grown.rows.count() == 5 and grown.unique
    assert {r.id for r in grown.rows.filter("version = 3").collect()} == {f"music/Class1/Song{i}no1mp3" for i in (0, 1)}
    bad = growing_store.rejects(spark, store).collect()
    assert [(r.file_type, r.id, r.reason, r.line) for r in bad] == [("chroma", "music/Class1/Song2no1mp3", "bad values", "music/Class 1/Song 2, no. 1.mp3; []")]
    assert bad[0].file.endswith("features1/out0.chroma")
    at_once = growing_store.extend(spark, songs, str(tmp_path / "other"))
    columns = [c for c in grown.rows.columns if c != "version"]
    assert sorted(map(str, at_once.rows.select(columns).collect())) == sorted(map(str, grown.rows.select(columns).collect()))
    with pytest.raises(FileNotFoundError):
        growing_store.extend(spark, str(tmp_path / "nowhere"), store)


def test_an_unreadable_line_is_parsed_once_and_compact_timbre_is_loaded(spark, songs, tmp_path):
    root = tmp_path / "songs"
    shutil.copytree(songs, root)
    (root / "features0" / "out0.mfcc").write_text("music/[x] a.mp3; [1.0, 2.0]; [3.0]; [4.0]\nbroken\n")
    found = files.load_tables(spark, str(root), compact=True, brackets=True)["mfcc"].collect()
    assert [(r.id, r.mfcc) for r in found] == [("music/xamp3", [1.0, 2.0, 3.0, 4.0])]
    assert "mfcc" not in files.load_tables(spark, str(root))


@pytest.mark.parametrize("options", [["build"], ["a", "--store", "x", "--strategy", "separate"], ["a", "--strategy", "lsh", "--features", "chroma+notes"]])
def test_options_that_do_not_fit_are_refused(options):
    with pytest.raises(SystemExit):
        arguments(options)
