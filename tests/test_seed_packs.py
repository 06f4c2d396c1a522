"""Seeded windows travel as shared stretches of text, and each is the slice it stands for."""

import random

from pyspark.sql import functions as F

from helixmill import catalogs
from helixmill import tables as T
from helixmill.operators.scan import PACK_LEN, _window, matcher, seed_packs
from helixmill.plans import pipelines as P
from helixmill.sources.fasta import sequences_from_dict

SEEDS = [(T.DETECTOR_KEYS.index(key), regex, size) for _, regex, _, size, _, key in catalogs.SEEDS]


def test_windows_lie_in_their_pack_and_text_is_not_copied_per_window(spark):
    r = random.Random(5)
    texts = {"long": "".join(r.choices("ACGT", k=60_000)), "short": "GAAGAAGAAGAAAAA", "none": ""}
    sequences = sequences_from_dict(spark, texts)
    found, carried, windows = set(), 0, 0
    for row in seed_packs(sequences, SEEDS).collect():
        bases, size = texts[row.seq_name], SEEDS[row.seed][2]
        assert row.text == bases[row.lo : row.lo + len(row.text)] and (len(row.text) <= PACK_LEN or len(row.starts) == 1)
        carried += len(row.text)
        for start, end in zip(row.starts, row.ends):
            lo, hi = _window(start, end, len(bases), size)
            assert row.lo <= lo and hi <= row.lo + len(row.text)
            windows += hi - lo
            found.add((row.seq_name, row.seed, start, end))
    want = {(name, n, s, e) for name, bases in texts.items() for n, (_, regex, _) in enumerate(SEEDS) for s, e in matcher(regex)(bases)}
    assert found == want
    assert carried < windows / 3  # joined window by window the text was as long as all windows


def test_equal_finds_of_windows_are_one_row_of_the_first_seed(spark):
    sequences = sequences_from_dict(spark, {"s": "ACGTTGCA" * 3 + "CACACACACACACACACACACA" + "TTGACAAAGGGTCCCATTT" * 2})
    plan = P.analyze(sequences, "seeded")
    rows = plan.collect()
    assert rows and len({(r["class"], r.subclass, r.start, r.end) for r in rows}) == len(rows)
    assert plan.where(F.col("seed_start") > F.col("end") + 350).count() == 0
    assert min(r.seed_start for r in rows if r["class"] == "Slipped_DNA") == 1  # the seed over the whole sequence is the first
