"""The table of window results: its columns in order, with their types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names and order of the columns of a window result; readers of these tables rely on both.
COLUMNS = """
participant_id long, cohort string, phase_mode string, window_type string, window_value string, window_start long, window_end long, n_days long, n_complete_cycles long,
seizure_count_total long, seizure_days_total long, analyzable_flag boolean, indeterminate_reason string, strict_herzog_eligible_flag boolean, short_cycle_modified_flag boolean,
luteal_anchored_ovulatory_flag boolean, c3_applicable_flag boolean,
adsf_M double, adsf_O double, adsf_F double, adsf_L double, adsf_FL double, adsf_OLM double, rr_C1 double, rr_C2 double, rr_C3 double,
label_A_exact_any boolean, label_A_exact_C1 boolean, label_A_exact_C2 boolean, label_A_exact_C3 boolean,
label_A_windowed_any boolean, label_A_windowed_excluding_C3 boolean, label_A_windowed_C1_or_C2 boolean, label_A_windowed_C1 boolean, label_A_windowed_C2 boolean, label_A_windowed_C3 boolean,
label_A_windowed_pattern_category string,
label_B_any boolean, label_B_excluding_C3 boolean, label_B_C1_or_C2 boolean, label_B_C1 boolean, label_B_C2 boolean, label_B_C3 boolean, label_B_pattern_category string,
label_C_any boolean, label_C_C1_or_C2 boolean, label_C_C1 boolean, label_C_C2 boolean, label_C_C3 boolean, label_C_pattern_category string,
label_D_any boolean, label_D_C1_or_C2 boolean, label_D_C1 boolean, label_D_C2 boolean, label_D_C3 boolean, label_D_pattern_category string,
label_D_window_alpha_any boolean, label_D_window_alpha_C1_or_C2 boolean, label_H1_any boolean, label_H2_any boolean, label_H3_any boolean, label_H4_any boolean
"""
SCHEMA = {name: kind for name, kind in (x.split() for x in COLUMNS.replace("\n", " ").split(","))}
#: Columns that the windows name otherwise.
OTHER_NAMES = {"window_start": "start_day", "window_end": "end_day"}


def ordered_row(df: DataFrame) -> DataFrame:
    """The columns of a window result first, in order and of their types, those that ``df`` lacks as typed nulls; the rest of ``df`` behind.

    ``participant_id`` keeps its own type. NaN, which the library never writes itself, becomes null.
    """
    out, taken = [], set()
    for name, kind in SCHEMA.items():
        source = name if name in df.columns else OTHER_NAMES.get(name, name)
        if source not in df.columns:
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        taken.add(source)
        c = F.col(source)
        if name != "participant_id":
            c = c.cast(kind)
        out.append((F.when(~F.isnan(c), c) if kind == "double" else c).alias(name))
    return df.select(*out, *[c for c in df.columns if c not in taken])
