"""DuckDB statements for the treatment comparison."""

from checks.cohort_sql import statement
from phasewise import names as N
from phasewise.sources import trial

T = N.TREATMENT
Z2 = "(1.959963984540054 * 1.959963984540054)"


def _number(variable: str) -> str:
    return f"cast({variable} - date '1970-01-01' as double)" if variable == N.INDEX else f"cast({variable} as double)"


PARTS = dict(trial.ANALYSIS)
PARTS |= {
    "pop": f"select * from in_analysis where {N.OTHER_TREATMENT} = 0 and {N.PRIOR_STAY} = 0",
    "scored": f"select *, ({N.OBSERVED_BEFORE} + 100) / 1100 as pr_score from pop",
    "weighted": f"""select s.*, 1 / pr_score as iptw, p / pr_score as wt_stab,
        case when {T} = 1 then p / pr_score else (1 - p) / (1 - pr_score) end as ipw
        from scored s, (select avg({T}) as p from scored)""",
    "fitted": f"select person_id, {T} as t, avg({T}) over (partition by race_ethnicity) as pr_score from pop",
    "cuts": """select quantile_cont(pr_score, 0.01) as lo, quantile_cont(pr_score, 0.99) as hi from fitted""",
    "numbers": " union all ".join(
        f"select '{v}' as variable, {T} as arm, {_number(v)} as x, ipw as w from weighted" for v in N.TABLE_NUMERIC
    ),
    "levels": " union all ".join(
        f"select '{v}' as variable, cast({v} as varchar) as level, {T} as arm, ipw as w from weighted"
        for v in N.TABLE_CATEGORICAL
    ),
    "described": """select variable, arm, cast(count(x) as double) as n, avg(x) as mean, stddev_samp(x) as sd
        from numbers group by variable, arm""",
    "weighted_means": "select variable, arm, sum(w * x) / sum(w) as mean from numbers group by variable, arm",
    "described_w": """select variable, arm, sum(w) as n, any_value(mean) as mean,
        sqrt(sum(w * (x - mean) ** 2) / sum(w) * count(x) / (count(x) - 1)) as sd,
        sum((w * (x - mean)) ** 2) as d2, count(x) as rows
        from numbers join weighted_means using (variable, arm) group by variable, arm""",
    "all_levels": """select variable, level, arm, cast(coalesce(c, 0) as double) as c, coalesce(cw, 0) as cw from (
        select * from (select distinct variable, level from levels), (select 0 as arm union all select 1))
        left join (select variable, level, arm, count(*) as c, sum(w) as cw from levels group by all)
        using (variable, level, arm)""",
    "shares": """select *, c / sum(c) over (partition by variable, arm) as p,
        cw / sum(cw) over (partition by variable, arm) as pw,
        dense_rank() over (partition by variable order by level) as rank from all_levels""",
    "sides": """select a.variable, a.level, a.rank, a.p as p1, b.p as p0, a.pw as w1, b.pw as w0, a.c as c1, b.c as c0
        from shares a join shares b using (variable, level) where a.arm = 1 and b.arm = 0""",
}


# Rao and Scott by explicit matrices over the cells (level x arm) of each variable: q projects on
# the interaction space, v is the design covariance, both scaled by the expected shares.
PARTS |= {
    "cell_sums": """select variable, level, arm, coalesce(sum(w), 0) as n, coalesce(sum(w * w), 0) as n2, count(w) as rows
        from all_levels left join levels using (variable, level, arm) group by all""",
    "cells": """select *, n / t as p, n2 / t ** 2 as s, r * c as e,
        sum(n2 / t ** 2) over (partition by variable) as ss from (
        select *, sum(n) over (partition by variable) as t, sum(rows) over (partition by variable) as m,
            sum(n) over (partition by variable, level) / sum(n) over (partition by variable) as r,
            sum(n) over (partition by variable, arm) / sum(n) over (partition by variable) as c from cell_sums)""",
    "cell_pairs": """select a.variable, a.level as l1, a.arm as a1, b.level as l2, b.arm as a2,
        ((a.level = b.level)::int - sqrt(a.r * b.r)) * ((a.arm = b.arm)::int - sqrt(a.c * b.c)) as q,
        a.m * a.m / (a.m - 1) * ((case when a.level = b.level and a.arm = b.arm then a.s else 0 end)
            - a.p * b.s - a.s * b.p + a.p * b.p * a.ss) / sqrt(a.e * b.e) as v
        from cells a join cells b using (variable)""",
    "projected": """select x.variable, x.l1, x.a1, y.l2, y.a2, sum(x.q * y.v) as g from cell_pairs x
        join cell_pairs y on x.variable = y.variable and x.l2 = y.l1 and x.a2 = y.a1 group by all""",
    "traces": """select variable, sum(case when x.l1 = x.l2 and x.a1 = x.a2 then x.g else 0 end) as trace,
        sum(x.g * y.g) as trace2
        from projected x join projected y using (variable) where x.l1 = y.l2 and x.a1 = y.a2 and x.l2 = y.l1 and x.a2 = y.a1
        group by variable""",
    "rao_scott": """select variable, statistic / trace as statistic, trace ** 2 / trace2 as df1,
        trace ** 2 / trace2 * (m - 1) as df2 from traces join (
        select variable, any_value(m) as m, any_value(m) * sum((p - e) ** 2 / e) as statistic from cells group by variable)
        using (variable)""",
}


def _tails(tests: str) -> str:
    """Upper tails of F, or chi-square without df2, by Simpson's rule on the density of the root."""
    log_density = """case when df2 is null
        then (df1 - 1) * ln(y) - y * y / 2 - (df1 / 2 - 1) * ln(2) - lgamma(df1 / 2)
        else ln(2) + lgamma((df1 + df2) / 2) - lgamma(df1 / 2) - lgamma(df2 / 2) + df1 / 2 * ln(df1 / df2)
            + (df1 - 1) * ln(y) - (df1 + df2) / 2 * ln(1 + df1 * y * y / df2) end"""
    return f"""select variable, sum(h / 3 * weight * exp({log_density})) as p from (
        select variable, df1, df2, 0.002 as h, case when k in (0, 20000) then 1 when k % 2 = 1 then 4 else 2 end as weight,
            greatest(sqrt(statistic), 1e-9) + 0.002 * k as y
        from ({tests}), (select unnest(range(20001)) as k)) group by variable"""


def _smd(numbers: str, p1: str, p0: str) -> str:
    """Two-level and larger categories by the same six sums, for shares p1 and p0."""
    a, d = f"(({p1} + {p0}) / 2)", f"({p1} - {p0})"
    return f"""select variable, round(abs(a.mean - b.mean) / sqrt((a.sd ** 2 + b.sd ** 2) / 2), 6) as smd
        from {numbers} a join {numbers} b using (variable) where a.arm = 1 and b.arm = 0
        union all
        select variable, round(sqrt(dd + (d1 * d1 * (1 - c00 / 2) + d1 * d0 * c10 + d0 * d0 * (1 - c11 / 2)) / 2
            / ((1 - c11 / 2) * (1 - c00 / 2) - c10 * c10 / 4)), 6) from (
        select variable, sum({d} ** 2 / {a}) as dd, sum({p1} * {d} / {a}) as d1, sum({p0} * {d} / {a}) as d0,
            sum({p1} ** 2 / {a}) as c11, sum({p1} * {p0} / {a}) as c10, sum({p0} ** 2 / {a}) as c00
        from sides where rank > 1 group by variable)"""


def _table(numbers: str, count: str, share: str, size: str) -> str:
    return f"""select 'n' as variable, cast(null as varchar) as level, {T} as arm, round({size}, 6) as n,
            cast(null as double) as mean, cast(null as double) as sd, cast(null as double) as percent
        from weighted group by {T}
        union all select variable, null, arm, round(n, 6), round(mean, 6), round(sd, 6), null from {numbers}
        union all select variable, level, arm, round({count}, 6), null, null, round(100 * {share}, 6)
        from shares where c > 0"""


def _balance() -> str:
    variables = ", ".join(f"'{v}'" for v in [*N.BALANCE_NUMERIC, *N.BALANCE_CATEGORICAL])
    return f"""select *, smd_weighted > {N.BALANCE_THRESHOLD} as unbalanced from (
        select variable, cast(null as varchar) as level,
            round(abs(a.mean - b.mean) / sqrt((a.sd ** 2 + b.sd ** 2) / 2), 6) as smd_unweighted,
            round(abs(wa.mean - wb.mean) / sqrt((a.sd ** 2 + b.sd ** 2) / 2), 6) as smd_weighted
        from described a join described b using (variable)
        join weighted_means wa using (variable) join weighted_means wb using (variable)
        where a.arm = 1 and b.arm = 0 and wa.arm = 1 and wb.arm = 0
        union all
        select variable, level, round(abs(p1 - p0) / sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2), 6),
            round(abs(w1 - w0) / sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2), 6) from sides)
        where variable in ({variables})"""


def _xlogy(x: str, y: str) -> str:
    return f"(case when {x} > 0 then {x} * ln({y}) else 0 end)"


def _odds(outcomes: list[str], weighted: bool) -> tuple[str, str]:
    """Parts and select for odds ratios; limits by repeated halving, one recursion for all rows."""
    w, kind = ("ipw", "w") if weighted else ("1.0", "u")
    cells = " union all ".join(
        f"""select '{y}' as outcome, count(*) as m, sum(case when {T} = 1 and {y} = 1 then {w} else 0 end) as a,
            sum(case when {T} = 1 and {y} = 0 then {w} else 0 end) as b,
            sum(case when {T} = 0 and {y} = 1 then {w} else 0 end) as c,
            sum(case when {T} = 0 and {y} = 0 then {w} else 0 end) as d from weighted"""
        for y in outcomes
    )
    phi = "(a + b + c + d) / (m - 2)" if weighted else "1.0"
    best0 = f"({_xlogy('c', 'c / (c + d)')} + {_xlogy('d', 'd / (c + d)')})"
    best1 = f"({_xlogy('a', 'a / (a + b)')} + {_xlogy('b', 'b / (a + b)')})"
    square, linear = "(exp(x) * (b + d))", "((a + b) * exp(x) + c + d - (a + c) * (1 + exp(x)))"
    odds = f"((sqrt({linear} ** 2 + 4 * {square} * (a + c)) - {linear}) / (2 * {square}))"
    effect_loss = (f"({best1} + {best0} - (a * ln(exp(x) * {odds}) + c * ln({odds}) "
                   f"- (a + b) * ln(1 + exp(x) * {odds}) - (c + d) * ln(1 + {odds})))")
    base_loss = f"({best0} - (c * x - (c + d) * ln(1 + exp(x))))"
    parts = f"""cells_{kind} as ({cells}),
        ends_{kind} as (select outcome, m, a, b, c, d, {phi} as phi, term, estimate, side,
            estimate as near, estimate + side * 80 as far from (
            select *, '(Intercept)' as term, ln(c / d) as estimate from cells_{kind}
            union all select *, '{T}', ln(a * d / (b * c)) from cells_{kind}),
            (select -1 as side union all select 1)),
        halving_{kind} as (
            select *, 0 as step from ends_{kind}
            union all
            select outcome, m, a, b, c, d, phi, term, estimate, side,
                case when ok then x else near end, case when ok then far else x end, step + 1 from (
                select *, 2 * (case when term = '{T}' then {effect_loss} else {base_loss} end) <= {Z2} * phi as ok
                from (select *, (near + far) / 2 as x from halving_{kind} where step < 60)))"""
    select = f"""select outcome, {str(weighted).lower()} as weighted, term, round(exp(estimate), 6) as odds_ratio,
            round(exp(max(near) filter (side = -1)), 6) as ci_low,
            round(exp(max(near) filter (side = 1)), 6) as ci_high
        from halving_{kind} where step = 60 group by outcome, term, estimate"""
    return parts, select


def _recursive(select: str, *own: str, parts: dict[str, str] | None = None) -> str:
    """A statement whose own parts follow the shared ones."""
    shared = statement("select * from weighted", parts or PARTS)
    before = shared[len("with "):-len(" select * from weighted")]
    return f"with recursive {', '.join([before, *own])} {select}"


ALL_OUTCOMES = [*N.OUTCOMES, N.LONG_TERM_OUTCOME]
FLAGS = ", ".join(trial.FLAG_RULES)


def _rows(condition: str) -> str:
    return f"""select * replace (round({N.OBSERVED_BEFORE}, 6) as {N.OBSERVED_BEFORE})
        from in_analysis where {condition}"""


SELECTS = {
    "population_vs_untreated": _rows(f"{N.OTHER_TREATMENT} = 0 and {N.PRIOR_STAY} = 0"),
    "population_active_comparator": _rows(f"{T} <> {N.OTHER_TREATMENT} and {N.PRIOR_STAY} = 0"),
    "population_followup": _rows(f"{N.FOLLOWED_UP} = 1"),
    "propensity": "select person_id, round(pr_score, 6) as pr_score from fitted",
    "ip_weights": """select person_id, round(iptw, 6) as iptw, round(wt_stab, 6) as wt_stab, round(ipw, 6) as ipw
        from weighted""",
    "trim_by_quantile": """select person_id, round(pr_score, 6) as pr_score from scored
        where pr_score > (select quantile_cont(pr_score, 0.01) from scored)
          and pr_score < (select quantile_cont(pr_score, 0.99) from scored)""",
    "weighted_population": """select person_id, round(pr_score, 6) as pr_score, round(1 / pr_score, 6) as iptw,
        round(p / pr_score, 6) as wt_stab,
        round(case when t = 1 then p / pr_score else (1 - p) / (1 - pr_score) end, 6) as ipw
        from fitted, cuts, (select avg(t) as p from fitted) where pr_score > lo and pr_score < hi""",
    "overlap_histogram": f"""select {T} as arm,
        cast(case when ipw < 0 then 0 when ipw >= 5 then 51 else floor(50 * ipw / 5) + 1 end as bigint) as bin,
        count(*) as n from weighted group by all""",
    "table_one": _table("described", "c", "p", "cast(count(*) as double)"),
    "table_one_weighted": _table("described_w", "cw", "pw", "sum(ipw)"),
    "smd": _smd("described", "p1", "p0"),
    "smd_weighted": _smd("described_w", "w1", "w0"),
    "group_tests": """select variable, 'F' as test,
            round(a.n * b.n / (a.n + b.n) * (a.mean - b.mean) ** 2
                / (((a.n - 1) * a.sd ** 2 + (b.n - 1) * b.sd ** 2) / (a.n + b.n - 2)), 6) as statistic,
            1.0::double as df1, a.n + b.n - 2 as df2
        from described a join described b using (variable) where a.arm = 1 and b.arm = 0
        union all
        select variable, 'chi-square', round(sum((abs(o - e) - case when k = 2 then least(0.5, abs(o - e)) else 0 end) ** 2 / e), 6),
            any_value(k) - 1, null from (
            select variable, c as o, max(rank) over (partition by variable) as k,
                sum(c) over (partition by variable, level) * sum(c) over (partition by variable, arm)
                    / sum(c) over (partition by variable) as e from shares) group by variable""",
    "group_tests_weighted": """select variable, 'F' as test,
            round((a.mean - b.mean) ** 2 / ((a.d2 / a.n ** 2 + b.d2 / b.n ** 2) * (a.rows + b.rows)
                / (a.rows + b.rows - 1)), 6) as statistic,
            1.0::double as df1, cast(a.rows + b.rows - 2 as double) as df2
        from described_w a join described_w b using (variable) where a.arm = 1 and b.arm = 0
        union all select variable, 'Rao-Scott', round(statistic, 6), round(df1, 6), round(df2, 6) from rao_scott""",
    "group_test_p_values": "select variable, round(p, 6) as p from p_values",
    "group_test_p_values_weighted": "select variable, round(p, 6) as p from p_values_w",
    "balance": _balance(),
}


PARTS["tests"] = SELECTS["group_tests"].replace("round(", "(").replace(", 6)", ")")
PARTS["tests_w"] = SELECTS["group_tests_weighted"].replace("round(", "(").replace(", 6)", ")")
PARTS["p_values"], PARTS["p_values_w"] = _tails("select * from tests"), _tails("select * from tests_w")


def _cramer(matrix: list[list[str]], vector: list[str]) -> list[str]:
    """Solution of three linear equations."""
    def det(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = m
        return (f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g}))"
                f" + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))")

    def replaced(k: int) -> list[list[str]]:
        return [[vector[r] if c == k else matrix[r][c] for c in range(3)] for r in range(3)]

    return [f"{det(replaced(k))} / {det(matrix)}" for k in range(3)]


ADJUSTED_TERMS = ["(Intercept)", T, N.ADJUSTED_FOR[0]]


def _adjusted(outcomes: list[str]) -> tuple[list[str], str]:
    """Weighted logistic fit with one covariate and its profile limits, Newton steps written out."""
    x = ["1.0", "t", "a"]
    data = " union all ".join(
        f"select '{y}' as outcome, cast({T} as double) as t, cast({N.ADJUSTED_FOR[0]} as double) as a, "
        f"cast({y} as double) as y, ipw as w from weighted" for y in outcomes)
    eta = "(b0 + b1 * t + b2 * a)"
    sums = ", ".join(
        [f"sum(w * (y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta))))) as ll", "sum(w * (y - mu) ** 2 / (mu * (1 - mu))) as pearson",
         "count(*) as m", *[f"sum(w * (y - mu) * {x[i]}) as g{i}" for i in range(3)],
         *[f"sum(w * mu * (1 - mu) * {x[i]} * {x[j]}) as h{i}{j}" for i in range(3) for j in range(3)]])

    def summed(name: str, source: str, keys: str) -> str:
        return f"""{name} as materialized (select {keys}, b0, b1, b2, {sums} from (
            select *, {eta} as eta, 1 / (1 + exp(-{eta})) as mu from adjusted_data join {source} using (outcome)) group by all)"""

    h = [[f"h{i}{j}" for j in range(3)] for i in range(3)]
    step = _cramer(h, ["g0", "g1", "g2"])
    parts = [f"adjusted_data as materialized ({data})",
             "fit_0 as materialized (select distinct outcome, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2 from adjusted_data)"]
    for k in range(12):
        parts += [summed(f"sum_{k}", f"fit_{k}", "outcome"),
                  f"fit_{k + 1} as materialized (select outcome, {', '.join(f'b{i} + {step[i]} as b{i}' for i in range(3))} from sum_{k})"]
    parts.append(summed("best", "fit_12", "outcome"))
    columns = [_cramer(h, [str(float(i == k)) for i in range(3)]) for k in range(3)]  # of the inverse
    starts = " union all ".join(
        f"""select outcome, {k} as term, {side} as side, b{k} as estimate, pearson / (m - 3) as phi, ll - {Z2} * pearson / (m - 3) / 2 as target,
            {', '.join(f'b{i} + {side} * sqrt({Z2} * pearson / (m - 3) / ({columns[k][k]})) * ({columns[k][i]}) as b{i}' for i in range(3))} from best"""
        for k in range(3) for side in (-1, 1))
    parts.append(f"end_0 as materialized ({starts})")
    rows = [[f"case when term = {i} then g{j} else -h{i}{j} end" for j in range(3)] for i in range(3)]
    aims = [f"case when term = {i} then ll - target else g{i} end" for i in range(3)]
    moved = _cramer(rows, aims)
    for k in range(15):
        parts += [summed(f"limit_{k}", f"end_{k}", "outcome, term, side, estimate, phi, target"),
                  f"""end_{k + 1} as materialized (select outcome, term, side, estimate, phi, target,
                      {', '.join(f'b{i} - {moved[i]} as b{i}' for i in range(3))} from limit_{k})"""]
    names_ = ", ".join(f"({i}, '{t}')" for i, t in enumerate(ADJUSTED_TERMS))
    at = "case term when 0 then b0 when 1 then b1 else b2 end"
    select = f"""select outcome, true as weighted, name as term, round(exp(any_value(estimate)), 6) as odds_ratio,
        round(exp(max({at}) filter (side = -1)), 6) as ci_low, round(exp(max({at}) filter (side = 1)), 6) as ci_high,
        case when isfinite(max({at}) filter (side = -1)) then 'reached' end as ci_low_status,
        case when isfinite(max({at}) filter (side = 1)) then 'reached' end as ci_high_status, true as converged, 0::bigint as rows_left_out
        from end_15 join (values {names_}) n(term, name) using (term) group by outcome, name"""
    return parts, select


CONDITIONS = {"vs_untreated": f"{N.OTHER_TREATMENT} = 0 and {N.PRIOR_STAY} = 0",
              "early_treatment": f"{N.OTHER_TREATMENT} = 0 and {N.PRIOR_STAY} = 0",
              "active_comparator": f"{T} <> {N.OTHER_TREATMENT} and {N.PRIOR_STAY} = 0",
              "long_term": f"{N.FOLLOWED_UP} = 1"}


def _logistic(treat: str, numeric: list[str], categorical: list[str], rounds: int = 12) -> dict[str, str]:
    """Parts with the scores of a logistic model (person_id, pr_score): reweighted least squares from the
    definition, one sum of products and one elimination over the rows of a matrix per round.

    The design is one list per person: 1, the numbers, and a 0/1 entry for every level but the first.
    """
    levels = ", ".join(f"(select list(distinct {c} order by {c}) from pop) as levels_{c}" for c in categorical)
    x = " || ".join(["[1.0::double]", *[f"[cast({v} as double)]" for v in numeric],
                     *[f"list_transform(levels_{c}[2:], lambda l: cast({c} = l as int)::double)" for c in categorical]])
    parts = {"design": f"select person_id, cast({treat} as double) as y, {x} as x from pop" + (f", (select {levels})" if levels else ""),
             "beta_0": "select list_transform(x, lambda v: 0.0::double) as beta from design limit 1"}
    for k in range(rounds):
        parts |= {
            f"means_{k}": f"select y, x, 1 / (1 + exp(-list_dot_product(x, beta))) as mu from design, beta_{k}",
            f"gram_{k}": f"""select i, list(h order by j) as r from (select i, j, sum(mu * (1 - mu) * x[i] * x[j]) as h
                from means_{k}, (select unnest(range(1, len(beta) + 1)) as i from beta_0), (select unnest(range(1, len(beta) + 1)) as j from beta_0)
                group by i, j) group by i""",
            f"slope_{k}": f"""select i, sum((y - mu) * x[i]) as g
                from means_{k}, (select unnest(range(1, len(beta) + 1)) as i from beta_0) group by i""",
            # one step makes one column that of the unit matrix; the last column becomes the solution.  A
            # covariate that follows from those before it has no pivot left and gets no share (0)
            f"solved_{k}": f"""select 0 as step, list(list_append(r, g) order by i) as m, list(r[i] order by i) as size
                from gram_{k} join slope_{k} using (i)
                union all select step + 1, list_transform(m, lambda r, i: case
                    when m[step + 1][step + 1] <= 1e-9 * size[step + 1] then list_transform(r, lambda v, j: case when i = step + 1 or j = step + 1 then 0 else v end)
                    when i = step + 1 then list_transform(r, lambda v: v / r[step + 1])
                    else list_transform(r, lambda v, j: v - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) end), size
                from solved_{k} where step < len(m)""",
            f"beta_{k + 1}": f"""select list_transform(beta, lambda b, i: b + m[i][len(m) + 1]) as beta
                from beta_{k}, solved_{k} where step = len(m)""",
        }
    return parts | {"scores": f"select person_id, 1 / (1 + exp(-list_dot_product(x, beta))) as pr_score from design, beta_{rounds}"}


def _with_model(chosen) -> dict[str, str]:
    """Parts of a comparison with all covariates of its score."""
    own = _by_group(chosen)
    before = {}
    for name, text in own.items():
        if name == "scored":
            before |= _logistic(chosen.weight_treatment, list(chosen.numeric), list(chosen.categorical))
            text = "select pop.*, pr_score from pop join scores using (person_id)"
        before[name] = text
    return before


def _report(chosen) -> str:
    """What a fit reports; covariates that follow from others are those left without a pivot."""
    entries = " || ".join([
        "['']", f"[{', '.join(repr(v) for v in chosen.numeric)}]::varchar[]",
        *[f"(select list('{c}_' || l order by l) from (select distinct {c} as l from pop) where l > (select min({c}) from pop))"
          for c in chosen.categorical]])
    return _recursive(f"""select '{chosen.name}' as comparison, '{chosen.weight_treatment}' as treatment, count(*) as rows,
            0::bigint as rows_left_out, min(pr_score) > 1e-8 and max(pr_score) < 1 - 1e-8 as converged,
            coalesce((select string_agg(name, ',' order by place) from (
                select unnest({entries}) as name, unnest(range(1, len(m) + 1)) as place, unnest(list_transform(m, lambda r, i: r[i])) as own
                from solved_0 where step = len(m)) where own = 0), '') as aliased
        from scores""", parts=_with_model(chosen))


def _by_group(chosen) -> dict[str, str]:
    """Parts of a comparison whose score is the treated share of each group."""
    treat, (low, high) = chosen.weight_treatment, chosen.trim
    return PARTS | {
        "pop": f"select * from in_analysis where {CONDITIONS[chosen.name]}",
        "scored": f"select *, avg({treat}) over (partition by race_ethnicity) as pr_score from pop",
        "weighted": f"""select s.*, 1 / pr_score as iptw, p / pr_score as wt_stab,
            case when {treat} = 1 then p / pr_score else (1 - p) / (1 - pr_score) end as ipw
            from scored s, (select avg({treat}) as p, quantile_cont(pr_score, {low}) as lo, quantile_cont(pr_score, {high}) as hi
            from scored) where pr_score > lo and pr_score < hi""",
    }


def _comparisons() -> dict[str, str]:
    from checks.comparison_queries import ONE_CATEGORY_COMPARISONS
    from phasewise.plans.comparison import COMPARISONS

    found = {}
    for c, own, ending in [*((c, _by_group(c), "_by_group") for c in ONE_CATEGORY_COMPARISONS),
                           *((c, _with_model(c), "") for c in COMPARISONS)]:
        found[f"weights_{c.name}{ending}"] = _recursive(
            f"""select person_id, {c.weight_treatment}, round(pr_score, 6) as pr_score, round(iptw, 6) as iptw,
                round(wt_stab, 6) as wt_stab, round(ipw, 6) as ipw from weighted""", parts=own)
        (plain, plain_select), (weighted, weighted_select) = (_odds(list(c.outcomes), w) for w in (False, True))
        found[f"outcomes_{c.name}{ending}"] = _recursive(
            f"select '{c.name}' as comparison, * from ({plain_select} union all {weighted_select})", plain, weighted, parts=own)
    found["fit_reports"] = " union all ".join(f"select * from ({_report(c)})" for c in COMPARISONS)
    c = ONE_CATEGORY_COMPARISONS[1]
    own = _by_group(c)
    for table, key in {"description": "table_one", "description_weighted": "table_one_weighted", "differences": "smd",
                       "differences_weighted": "smd_weighted", "tests": "group_tests", "tests_weighted": "group_tests_weighted",
                       "balance": "balance"}.items():
        found[f"comparison_{table}"] = statement(SELECTS[key], own)
    found["comparison_outcomes"] = found[f"outcomes_{c.name}_by_group"]
    adjusted, select = _adjusted(list(c.outcomes))
    found["comparison_outcomes_adjusted"] = _recursive(select, *adjusted, parts=own)
    return found


def statements() -> dict[str, str]:
    found = {key: statement(select, PARTS) for key, select in SELECTS.items()}
    plain, weighted = (_odds(ALL_OUTCOMES, w) for w in (False, True))
    found["odds_ratio_unweighted"] = _recursive(plain[1], plain[0])
    found["odds_ratio_weighted"] = _recursive(weighted[1], weighted[0])
    (plain, plain_select), (weighted, weighted_select) = (_odds(N.OUTCOMES, w) for w in (False, True))
    both = f"select 'vs_untreated' as comparison, * from ({plain_select} union all {weighted_select})"
    found["outcome_table"] = _recursive(both, plain, weighted)
    adjusted, adjusted_select = _adjusted(N.OUTCOMES)
    found["odds_ratio_adjusted"] = _recursive(adjusted_select, *adjusted)
    return found | _comparisons()
