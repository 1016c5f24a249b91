"""Ingest by committed groups of pixels: breaking off, resuming, trying again, changed inputs, nothing left behind."""

from dataclasses import replace

import pytest
from test_run import SF, inputs

from lumitie import schema as S
from lumitie.config import Config
from lumitie.plans import manifest as M
from lumitie.plans import run as RUN
from lumitie.sources import fixtures as X
from lumitie.sources import tables as T

CFG = replace(Config(), quality_cuts=replace(Config().quality_cuts, exclude_ccdnums=(6,)))


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("manifest")
    inputs(spark, f"{root}/in")
    return root


@pytest.fixture(scope="module")
def pixels(spark):
    from lumitie.functions.healpix import with_pixel

    held = sorted(r[0] for r in with_pixel(X.stars(spark, SF), 32).select("healpix_pixel").distinct().collect())[:7]
    return spark.createDataFrame([(p,) for p in [*held, 0, 1]], "healpix_pixel bigint")     # two of them are empty


def run(spark, source, out, pixels, group=3):
    return RUN.Run(spark, f"{source}/in", f"{source}/{out}", CFG, pixels, pixel_group=group)


def rows(r):
    return sorted(map(tuple, r.detections("g").select("healpix_pixel", "objectid", "expnum", "ccdnum", "m_inst", "m_err").collect()))


@pytest.fixture(scope="module")
def clean(spark, source, pixels):
    r = run(spark, source, "clean", pixels, None)
    r.phase_0("g")
    return rows(r)


def failing(monkeypatch, times):
    """Let the write of a group fail so many times, after the first group, half-way: its partitions are there, the commit is not."""
    real, calls = T.write_pixels, []

    def write(df, path):
        real(df, path)
        calls.append(path)
        if 1 < len(calls) <= 1 + times:
            raise OSError("executors lost")

    monkeypatch.setattr(T, "write_pixels", write)
    return calls


def test_breaks_off_resumes_and_equals_a_clean_run(spark, source, pixels, clean, monkeypatch):
    calls = failing(monkeypatch, 99)
    with pytest.raises(OSError):
        run(spark, source, "broken", pixels).phase_0("g")
    assert len(calls) == 1 + 2 * M.ATTEMPTS          # three groups at first, two of them in every round
    first = run(spark, source, "broken", pixels)
    assert first.manifest("g").committed().count() == 3 and first.manifest("g").missing(pixels).count() == 6
    monkeypatch.undo()
    # what a break left of an uncommitted pixel must not stay
    left = first.manifest("g").missing(pixels).first()[0]
    held = spark.createDataFrame([(left, "ghost", 1, 1, "g", 1.0, 0.1)], "healpix_pixel bigint, objectid string, expnum bigint, ccdnum int, band string, m_inst double, m_err double")
    T.write_pixels(T.pad_columns(held, S.DETECTIONS), first.path("detections", "g"))
    seen = []
    monkeypatch.setattr(T, "write_pixels", lambda df, path, real=T.write_pixels: (seen.append(path), real(df, path)))
    first.phase_0("g")
    assert len(seen) == 2 and rows(first) == clean
    counts = {r.healpix_pixel: r.n_detections for r in first.manifest("g").committed().collect()}
    assert counts[0] == counts[1] == 0 and sum(counts.values()) == len(clean)
    first.phase_0("g")
    assert len(seen) == 2                             # nothing is missing, so nothing is read or written


def test_a_lost_group_is_tried_again(spark, source, pixels, clean, monkeypatch):
    calls = failing(monkeypatch, 1)
    r = run(spark, source, "again", pixels)
    r.phase_0("g")
    assert len(calls) == 4 and rows(r) == clean


def test_start_at_phase_1_finishes_the_ingest(spark, source, pixels, clean, monkeypatch):
    r = run(spark, source, "late", pixels.where("healpix_pixel > 1").orderBy("healpix_pixel").limit(4))
    r.phase_0("g")
    r = run(spark, source, "late", pixels)
    done = []
    for phase in RUN.FIRST[1:] + RUN.SECOND:
        monkeypatch.setattr(RUN.Run, f"phase_{phase}", lambda self, band, phase=phase: done.append(phase))
    r.phases(["g"], "1")
    assert rows(r) == clean and done == list(RUN.FIRST[1:] + RUN.SECOND)


def test_changed_inputs_and_cuts_start_anew(spark, source, pixels):
    r = run(spark, source, "clean", pixels)
    same = r.manifest("g").mark
    assert r.manifest("g").mark == same and r.manifest("g").missing(pixels).count() == 0
    r.cfg = replace(CFG, quality_cuts=replace(CFG.quality_cuts, max_detections_per_star=9))
    assert r.manifest("g").mark != same and r.manifest("g").missing(pixels).count() == 9
    r.cfg = CFG
    T.write(spark.read.parquet(f"{source}/in/chip").limit(5), f"{source}/other/chip")
    assert M.fingerprint(spark, [f"{source}/other/chip"], CFG) != M.fingerprint(spark, [f"{source}/in/chip"], CFG)
    assert M.fingerprint(spark, [f"{source}/nowhere"], CFG)


def test_a_failing_run_leaves_no_staged_tables(spark, source, pixels, monkeypatch):
    r = run(spark, source, "clean", pixels)

    def stop(self, band):
        self.stage.write(self.spark.range(3), "left")
        raise ValueError("stop")

    monkeypatch.setattr(RUN.Run, "phase_2", stop)
    with pytest.raises(ValueError):
        r.phases(["g"], "2")
    assert not T.exists(spark, r.stage.root)
