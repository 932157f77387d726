import numpy as np
import pytest

from tarnloom.llm import audio


def test_excerpts_are_found_where_they_were_cut():
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.125, (40, 64))
    whole = [audio.integers(audio.samples_of(audio.melody(v))) for v in vectors]
    for k, v in enumerate(vectors[:10]):
        part = audio.integers(audio.samples_of(audio.melody(v, start=12 * audio.HOP + 9, gain=0.2)))
        errors = [audio.overlap_error(part, w, 12)[0] for w in whole]
        assert int(np.argmin(errors)) == k and errors[k] < 0.15 < sorted(errors)[1]


def test_recall_against_brute_force(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    vectors = spark.read.parquet(path)
    rows = sorted(vectors.collect(), key=lambda r: r.vec_id)
    prints = {r.vec_id: audio.integers(audio.samples_of(audio.melody(r.embedding))) for r in rows}
    want = set()
    for r in rows:
        if r.vec_id % 100 == 0:
            part = audio.integers(audio.samples_of(audio.melody(r.embedding, 10 * audio.HOP + 17, 0.3)))
            for i, x in prints.items():
                best = min((e for o in range(-80, 80) for e, n in [audio.overlap_error(part, x, o)] if n >= audio.LEAST_OVERLAP), default=1)
                if best <= 0.25:
                    want.add((r.vec_id, i))
    got = {(m.query_id, r.vec_id) for r in audio.search(vectors).collect() for m in r.matches}
    assert len(want & got) >= 0.9 * len(want) and len(want) >= 5


def test_copies_share_a_class_and_odd_rows_match_nothing(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.normal(0, 0.125, 64).tolist() for _ in range(2))
    rows = [(0, a), (7, a), (100, a), (5, b), (6, None), (8, []), (9, [None] * 64), (None, b), (200, [float("nan")] * 64), (5, b)]
    got = audio.search(spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, ints int, matches string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert by[0][0].class_id == by[7][0].class_id == by[100][0].class_id == 0 and by[None][0].class_id == 5 and len(by[5]) == 2
    assert [m.query_id for m in by[7][0].matches] == [0] and by[6][0].n_ints == 0 and by[6][0].matches == [] and by[8][0].class_id == 8
    assert not by[5][0].matches


def test_no_recordings(spark):
    assert audio.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
    assert len(audio.integers(audio.samples_of(None))) == 0


@pytest.mark.parametrize("n", [0, 100, audio.FRAME])
def test_short_recordings(n):
    assert len(audio.integers(np.zeros(n, np.float32))) == 0


def test_recordings_as_a_column(spark):
    rng = np.random.default_rng(3)
    pcm = [audio.melody(rng.normal(0, 0.125, 64)) for _ in range(3)] + [None, b"", b"\x01"]
    got = {r.id: bytes(r.ints) for r in audio.fingerprints(spark.createDataFrame(list(enumerate(pcm)), "id long, pcm binary")).collect()}
    assert got == {k: audio.integers(audio.samples_of(p)).astype("<u4").tobytes() for k, p in enumerate(pcm)}
