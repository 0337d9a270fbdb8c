"""Every operator on nulls, empty and long texts, ties, repeated rows, empty
tables and columns with clashing names."""

from __future__ import annotations

import pytest

from relkit.llm import (exact_stream, lang_cnn, mixing, omh_dedup, packing, pii_bootstrap, quality_knn, secret_scan,
                        syncmers, toxicity)

BY_DOCUMENT = {
    "lang": lambda d, lab: lang_cnn.languages(d),
    "near": lambda d, lab: omh_dedup.near_classes(d),
    "secrets": lambda d, lab: secret_scan.secrets(d),
    "pii": lambda d, lab: pii_bootstrap.personal(d),
    "mix": lambda d, lab: mixing.mix(d),
    "fingerprints": lambda d, lab: syncmers.fingerprints(d),
    "toxicity": lambda d, lab: toxicity.toxicity(d, lab),
    "exact": lambda d, lab: exact_stream.exact_groups(d),
    "quality": lambda d, lab: quality_knn.quality(d, lab),
}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_a_document(name, awkward, clashing, none, labels):
    run = BY_DOCUMENT[name]
    got = rows(run(awkward, labels))
    assert len(got) == awkward.count()
    assert rows(run(clashing, labels)) == got  # other columns change nothing
    assert run(none, labels).count() == 0


def test_pack_takes_them(awkward, clashing, none):
    got = rows(packing.pack(awkward, size=64))
    assert len(rows(packing.pack(clashing, size=64))) == len(got) >= awkward.count()
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("stage", [lang_cnn.known_language, exact_stream.exact_dedup, omh_dedup.near_dedup,
                                   mixing.mixed])
def test_stages_keep_the_columns(stage, clashing, none):
    out = stage(clashing)
    assert out.columns == clashing.columns and out.count() > 0
    assert stage(none).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_nothing_labelled(name, awkward, labels):
    got = BY_DOCUMENT[name](awkward, labels.limit(0)).collect()
    assert len({r.score for r in got}) == 1
