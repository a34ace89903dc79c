"""Every registered query against its SQL on the smallest tables."""

import pytest

import registry
from oracle import compare, connection

registry.load()

# The survey's operator keys.
EXPECTED = """
src_csv_typed src_html_table_rows src_html_comment_blocks src_feature_list src_json_fields src_model_load snk_table
snk_model_metadata prj_rename_map prj_keep_existing prj_select_by_prefix prj_drop_private prj_default_columns
prj_literal_metadata prj_request_overrides flt_repeated_header flt_summary_rows flt_dnp_rows flt_missing_targets
flt_min_exposure flt_entity_ci flt_complete_rows flt_alert_status flt_target_present flt_time_before_after
ded_first_by_key ded_roster_by_id ded_duplicate_report jn_left_context jn_assert_many_to_one jn_rival_dimension
jn_side_dimension jn_id_to_code jn_rank_backfill jn_triple_lookup_defaults jn_unmatched_report jn_name_resolution
jn_next_event jn_prev_event_rest jn_missing_pairs jn_task_grid jn_live_overlay jn_context_with_fallback
agg_entity_counts agg_first_non_null agg_home_win_rate agg_group_median_fill agg_league_mean_scale agg_profile
agg_null_rates agg_value_counts agg_low_count_flag agg_mean_by_group agg_best_per_period agg_flag_sum_share
agg_availability agg_recent_mean_std agg_hit_rate agg_error_metrics agg_entity_mean_all agg_min_max_range
agg_detect_marker_column agg_feature_log_stats win_lagged_rolling_mean win_lagged_rolling_std
win_period_expanding_mean win_rival_rolling_mean win_lagged_rate_min3 win_cumcount win_period_start_offset
win_trailing_days_count win_rest_days win_average_rank win_average_rank_truncated win_latest_row win_trend_ratio
win_rolling_ratio_features win_as_of_next top_recent_n top_n_desc top_search_prefix top_feature_importance
top_reasons top_signed_summary srt_event_order set_union_by_name set_except_expected scl_code_normalise
scl_parse_minutes scl_home_from_matchup scl_composite_score scl_usage_rate scl_true_shooting scl_rate_per_exposure
scl_won_flag scl_clip scl_sentinel_replace scl_category_encode scl_phase_bucket scl_availability_status
scl_season_label scl_starter_flag scl_normal_cdf scl_probability_blend scl_prediction_range scl_warnings_array
scl_reason_label scl_verdict scl_nonneg_round scl_gauge_band scl_numeric_coerce scl_date_coerce
scl_missing_feature_fill scl_pct_display scl_date_display spl_time_series_split spl_holdout_tail ml_train_per_target
ml_temporal_cv ml_batch_score ml_contributions ml_contributions_linear pip_training_dataset pip_features
pip_schedule_context pip_positional_defense pip_next_event_context pip_request_features pip_probability
pip_prediction_card pip_gamelog_extract str_live_refresh str_rolling_state
""".split()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


def test_every_operator_is_registered():
    assert set(EXPECTED) <= set(registry.QUERIES)
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        assert compare(df, con, registry.ORACLES[name]) == []
    else:
        assert df.count() > 0
