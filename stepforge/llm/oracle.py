"""SQL twins of the training-data queries, and of their invariants, that SQL can express."""

from __future__ import annotations

from stepforge.llm.queries import CAP_COUNT, CAP_SHARE, SAMPLE_RATE
from stepforge.llm.sampling import SALT
from stepforge.plans.oracle import canonical_id, canonical_repo

_INSTANCE = r"""regexp_replace(regexp_replace(lower({}), '^[\s"''`]+|[\s"''`]+$', '', 'g'), '^([^/]+?)(?:__|/)(.+)[-_#]0*(\d+)$', '\1__\2-\3')"""


def _instance(c: str) -> str:
    return f"nullif({_INSTANCE.format(c)}, '')"


def _instance_repo(c: str) -> str:
    return f"nullif(replace(regexp_extract({_instance(c)}, '^(.+)-\\d+$', 1), '__', '/'), '')"


_REPO = f"coalesce({canonical_repo('repo')}, {_instance_repo('instance_id')})"

# A NULL counts as a value of the last row, hence the structs.
CONTRIBUTIONS = f"""
b AS (SELECT {canonical_id("trajectory_id")} AS trajectory_id, arg_max(struct_pack(v := composite_score), scored_at).v AS composite_score FROM scored GROUP BY 1),
c AS (SELECT trajectory_id, repo, composite_score FROM (SELECT {canonical_id("trajectory_id")} AS trajectory_id, arg_max(struct_pack(r := {_REPO}), ingested_at).r AS repo FROM stats GROUP BY 1)
        LEFT JOIN b USING (trajectory_id) WHERE trajectory_id IS NOT NULL),
n AS (SELECT greatest(1, floor(count(*) * {CAP_SHARE} + 1e-9)) AS most FROM c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY composite_score DESC NULLS LAST, md5(trajectory_id), trajectory_id) AS r FROM c)
"""

LENGTHS = f"""
len AS (SELECT {canonical_id("trajectory_id")} AS trajectory_id, arg_max(total_tokens, (ingested_at, total_tokens)) AS total_tokens FROM stats WHERE total_tokens IS NOT NULL GROUP BY 1)
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name; operators on words, tokenisers, sequences and models have none."""
    u = f"(('0x' || substr(md5('{SALT}:' || {{}}), 1, 13))::UBIGINT / 4503599627370496.0)"
    key = canonical_id("trajectory_id")
    entity = {"repo": f"coalesce({_REPO}, 'trajectory:' || {key})", "instance": f"coalesce({_instance('instance_id')}, 'trajectory:' || {key})"}
    return {
        "p4_sample": f"SELECT {key} AS trajectory_id, count(*) AS n_rows, round({u.format(key)}, 9) AS u FROM stats WHERE {u.format(key)} < {SAMPLE_RATE} GROUP BY ALL",
        "p4_stability": f"""WITH f AS (SELECT {key} AS k, min(ingested_at) AS t FROM stats GROUP BY 1),
          p AS (SELECT k, coalesce(least(4, floor((epoch_us(t) - epoch_us(lo)) * 4 / greatest(epoch_us(hi) - epoch_us(lo), 1)) + 1), 4) AS part FROM f, (SELECT min(t) AS lo, max(t) AS hi FROM f))
          SELECT "at", count(*) AS n_ids, count(*) FILTER ({u.format('k')} < {SAMPLE_RATE}) AS n_sampled, round(count(*) FILTER ({u.format('k')} < {SAMPLE_RATE}) / count(*), 6) AS share
          FROM range(1, 5) AS r("at") JOIN p ON part <= "at" GROUP BY 1""",
        "p3_cap_count": f"WITH {CONTRIBUTIONS} SELECT trajectory_id, repo, composite_score FROM ranked WHERE repo IS NULL OR r <= {CAP_COUNT}",
        "p3_cap_share": f"WITH {CONTRIBUTIONS} SELECT trajectory_id, repo, composite_score FROM ranked, n WHERE repo IS NULL OR r <= most",
        "p3_report": f"""WITH {CONTRIBUTIONS} SELECT repo, count(*) AS n_before, count(*) FILTER (repo IS NULL OR r <= most) AS n_after,
          round(min(composite_score) FILTER (repo IS NULL OR r <= most), 6) AS lowest_kept FROM ranked, n GROUP BY repo""",
        "p2_totals": f"""WITH {LENGTHS}, e AS (SELECT trim(name) AS experiment, lower(trim(subset)) AS subset, max(context_length) AS context_length FROM experiments WHERE context_length > 0 GROUP BY 1, 2),
          m AS (SELECT DISTINCT lower(trim(subset_name)) AS subset, {key} AS trajectory_id FROM split_rows)
          SELECT experiment, CAST(context_length AS BIGINT) AS context_length, count(*) AS n_trajectories, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_cut_needlessly
          FROM m JOIN e USING (subset) JOIN len USING (trajectory_id) WHERE total_tokens > 0 GROUP BY 1, 2""",
        "p2_unknown": f"""WITH {LENGTHS}, e AS (SELECT DISTINCT trim(name) AS experiment, lower(trim(subset)) AS subset FROM experiments WHERE context_length > 0),
          m AS (SELECT DISTINCT lower(trim(subset_name)) AS subset, {key} AS trajectory_id FROM split_rows)
          SELECT experiment, count(*) AS n_trajectories, count(*) FILTER (coalesce(total_tokens, 0) <= 0) AS n_unknown FROM m JOIN e USING (subset) LEFT JOIN len USING (trajectory_id) GROUP BY 1""",
        "p5_totals": f"""WITH {LENGTHS}, s AS (SELECT {key} AS trajectory_id, step_idx, arg_max(n, (known, ingested_at, n)) AS n FROM (SELECT *, n_tokens IS NOT NULL AS known,
            coalesce(greatest(n_tokens, 0), CAST(ceil((coalesce(length(action_text), 0) + coalesce(length(obs_text), 0)) / 4) AS BIGINT)) AS n FROM steps WHERE step_idx IS NOT NULL) GROUP BY 1, 2),
          k AS (SELECT trajectory_id, sum(n) AS known FROM s GROUP BY 1), e AS (SELECT DISTINCT context_length FROM experiments WHERE context_length > 0)
          SELECT context_length, count(*) AS n_trajectories, CAST(sum(greatest(total_tokens, coalesce(known, 0))) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS n_too_long, CAST(0 AS BIGINT) AS n_gaps
          FROM e JOIN len ON total_tokens > context_length LEFT JOIN k USING (trajectory_id) GROUP BY 1""",
        **{f"p6_purity_{by}": f"SELECT count(*) AS n_rows, count(DISTINCT {x}) AS n_entities, CAST(0 AS BIGINT) AS n_divided FROM stats" for by, x in entity.items()},
        "p9_limits": "SELECT CAST(0 AS BIGINT) AS n_over_repeats, CAST(0 AS BIGINT) AS n_repeated_texts, CAST(0 AS BIGINT) AS n_other_sources",
    }
