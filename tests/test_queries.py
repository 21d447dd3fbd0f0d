"""Every registered query without the corpus subpackage: its SQL runs on the same tables and gives the same rows."""

import os

import pytest

from voxelframe import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["a13_volume_stats", "j2_label_overlap_argmax", "a17_aggregate_by_group", "a1_cell_intensity", "j16_cell_distance", "g8_label_edges", "g13_connected_components", "g16_reconcile_slabs", "j18_crop_iou", "w1_empirical_cdf", "a21_binary_scores", "s27_sequence_numbers", "p12_painted_cells", "a6_surface", "g2_gaussian", "g2_median", "g2_edges", "w8_gap_fill", "j20_series", "g6_random_crops", "g11_flips", "g11_shifts", "g5_channel_cubes", "g20_equalised", "g21_preprocessed_channel", "a36_rule_violations", "m7_mutual_information", "w3_decimated", "s24_channel_summary", "s22_projector_export", "p19_marker_mismatch", "j21_metrics_by_annotated_slice", "a5_eigenvalues", "g11_dihedral_variants", "a40_merged_predictions", "g12_tiles", "g15_slabs", "g16_unlike_slabs"]


def cell(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = plans.QUERIES[name](spark, SF)
    want = db.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda found: sorted(tuple(map(cell, r)) for r in found)
    assert rows(got.select(names).collect()) == rows(want.fetchall())


def test_every_sql_has_a_query():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


RAGGED = ["g11_shifts", "g19_pad_reflect", "g19_pad_constant", "g21_preprocessed_channel", "g2_box_mean", "g2_edges", "g2_gaussian", "g2_median", "g8_label_edges", "g3_membrane", "j15_empty_space_distance", "p29_separated_labels", "p31_training_channels", "p32_three_classes"]


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    """Tables whose last slice has 6 of its 25 lines."""
    import duckdb

    path = tmp_path_factory.mktemp("ragged")
    duckdb.execute(f"copy (select * from '{SF}/embeddings.parquet' where vec_id < 256) to '{path}/embeddings.parquet' (format parquet)")
    return str(path)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", RAGGED)
def test_query_equals_its_sql_where_a_slice_lacks_voxels(spark, ragged, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{ragged if t == 'embeddings' else SF}/{t}.parquet'")
    want = db.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = lambda found: sorted(tuple(map(cell, r)) for r in found)
    assert rows(plans.QUERIES[name](spark, ragged).select(names).collect()) == rows(want.fetchall())


def test_halves_of_a_digit_are_rounded_as_in_sql(spark):
    import duckdb

    from voxelframe.plans.measure_queries import nearest_digits

    values = [0.158625, 0.153125, -0.118125, 1.005, 2.675, -0.0, 0.33304499999, *[(2 * k + 1) / 200000 for k in range(300)]]
    found = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").orderBy("k").select(nearest_digits("x", 5)).collect()]
    assert found == [duckdb.execute("select round(?::double, 5) + 0.0", [x]).fetchone()[0] for x in values]
