"""DuckDB SQL with the same rows as the registered queries of the read operators."""

from __future__ import annotations

from seqmill.sources.derived_reads import LENGTH, SIZES, _base

_READS = f"""
keyed as (select concat('s', cast(l_suppkey % 3 as varchar)) as sample, concat('chr', l_returnflag) as chrom,
  cast((l_partkey*7 + l_linenumber*3) % 400 as int) as pos, cast(l_orderkey % 2 as int) as is_reverse,
  cast(1 + l_linenumber % 2 as int) as read_num, cast(l_quantity as int) as mapq, l_orderkey as ok, l_partkey as pk, l_linenumber as ln from lineitem),
reads as (select *, concat({", ".join(_base(i) for i in range(LENGTH))}) as seq from keyed),
calls as (select sample, chrom, is_reverse, read_num, mapq, seq, cast(qpos as int) as qpos, pos, cast(pos + qpos as int) as refpos,
  cast(10 + (ok + qpos*5 + ln*3) % 31 as int) as bq, substr(seq, cast(qpos + 1 as int), 1) as letter,
  case when is_reverse = 1 then {LENGTH} - cast(qpos as int) else cast(qpos as int) end as dend
  from (select *, unnest(range({LENGTH})) as qpos from reads)),
pile as (select chrom, sample, refpos as pos, count(*) filter (letter = 'A') as n_a, count(*) filter (letter = 'C') as n_c,
  count(*) filter (letter = 'G') as n_g, count(*) filter (letter = 'T') as n_t from calls where bq >= 20 group by 1, 2, 3)
"""


#: Of each alignment in turn, its runs of matches (query, reference from pos on, bases) and the reference bases that it spans.
_RUNS = [[(0, 0, 12)], [(5, 0, 7)], [(0, 0, 3), (5, 3, 7)], [(0, 0, 4), (4, 6, 8)], [(0, 0, 3), (3, 13, 9)], [(0, 0, 16)], [(0, 0, 8), (8, 12, 5)], [(1, 0, 3), (5, 3, 2), (7, 8, 5)]]
_SPANS = [12, 7, 10, 14, 22, 16, 17, 13]
_VARIED = f"""
keyed as (select concat('s', cast(l_suppkey % 3 as varchar)) as sample, concat('chr', l_returnflag) as chrom,
  cast((l_partkey*7 + l_linenumber*3) % 400 as int) as pos, cast(l_orderkey % 2 as int) as is_reverse,
  cast(1 + l_linenumber % 2 as int) as read_num, cast(l_quantity as int) as mapq, l_orderkey as ok, l_partkey as pk, l_linenumber as ln,
  cast((l_orderkey + l_partkey) % {len(_RUNS)} as int) as kind from lineitem where l_orderkey % 13 <> 0 and l_orderkey % 17 <> 0 and l_orderkey % 19 <> 0),
reads as (select *, substr(concat({", ".join(_base(i) if i != 6 else f"case when ok % 11 = 0 then 'N' else {_base(i)} end" for i in range(max(SIZES)))}), 1, {SIZES}[kind + 1]) as seq, {_SPANS}[kind + 1] as alen from keyed),
runs(kind, q, r, n) as (values {", ".join(f"({k}, {q}, {r}, {n})" for k, runs in enumerate(_RUNS) for q, r, n in runs)}),
calls as (select *, cast(10 + (ok + qpos*5 + ln*3) % 31 as int) as bq, substr(seq, qpos + 1, 1) as letter, case when is_reverse = 1 then alen - qpos else qpos end as dend
  from (select * exclude (i), cast(q + i as int) as qpos, cast(pos + r + i as int) as refpos from (select *, unnest(range(n)) as i from reads join runs using (kind))))
"""


def _context(k: int) -> str:
    return f"case when is_reverse = 1 then translate(reverse(substr(seq, qpos + 2, {k})), 'ACGT', 'TGCA') else substr(seq, qpos - {k} + 1, {k}) end"


def _inside(k: int) -> str:
    return f"case when is_reverse = 1 then qpos < {LENGTH} - {k} else qpos >= {k} end"


_ORIENTED = "case when is_reverse = 1 then translate(letter, 'ACGT', 'TGCA') else letter end"
_CONSENSUS = "case when n_a + n_c + n_g + n_t < {n} then 'N' when n_a = greatest(n_a, n_c, n_g, n_t) then 'A' when n_c = greatest(n_a, n_c, n_g, n_t) then 'C' when n_g = greatest(n_a, n_c, n_g, n_t) then 'G' else 'T' end"
_ALLELES = """
ranked as (select chrom, sample, pos, row_number() over (partition by chrom, sample, pos order by n desc, base desc) as r, case when n > 0 then base else 'N' end as base
  from (select chrom, sample, pos, unnest(['A', 'C', 'G', 'T']) as base, unnest([n_a, n_c, n_g, n_t]) as n from pile)),
alleles as (select chrom, sample, pos, max(base) filter (r = 1) as major, max(base) filter (r = 2) as minor from ranked group by 1, 2, 3)
"""
_SITES = f"""
cons as (select chrom, sample, pos, {_CONSENSUS.format(n=20)} as consensus from pile),
contam as (select a.chrom, a.sample, a.pos, a.consensus,
{",".join(f"coalesce(count(*) filter (a.consensus <> 'N' and b.consensus <> a.consensus and b.consensus = '{x}'), 0) / greatest(count(*) filter (b.consensus <> 'N'), 1)::double as contam_{x.lower()}" for x in "ACGT")}
  from cons a left join cons b on a.chrom = b.chrom and a.pos = b.pos and a.sample <> b.sample group by 1, 2, 3, 4)
"""


def _observed(k: int) -> str:
    flip = lambda a, b: f"case when is_reverse = 1 then contam_{b} else contam_{a} end as contam_{a}"
    return f"""
observed as (select chrom, sample, pos, is_reverse, read_num, base, bq, mapq, dend_bin, context, {flip("a", "t")}, {flip("c", "g")}, {flip("g", "c")}, {flip("t", "a")}, major, minor
  from (select chrom, sample, refpos as pos, is_reverse, read_num, {_ORIENTED} as base, bq, mapq, cast(floor((dend + 5.0) / 10) * 10 as int) as dend_bin, {_context(k)} as context
    from calls where mapq >= 20 and bq >= 20 and {_inside(k)}) join contam using (chrom, sample, pos) join alleles using (chrom, sample, pos) where consensus <> 'N' and major <> 'N')
"""


_COUNTS = ", ".join(f"count(*) filter (base = '{b}') as n_{b.lower()}" for b in "ACGT")
_KEYS = "bq, mapq, dend_bin, context, contam_a, contam_c, contam_g, contam_t, sample"
_COARSE = "dend_bin, context, contam_a, contam_c, contam_g, contam_t"
_POINTS = 16
_T = lambda n, p: f"(exp({n}::double / {p} * ln(1 + 10 * 0.5)) - 1) / 10"


def _grid(points: str, b: str = "20.0") -> str:
    low, high = (f"(1 - pow(1 - {v}, {b}))" for v in ("v0", "v1"))
    return f"""
bounds as (select k::int as k, case when k > 0 then {_T("(k - 1)", f"({points} - 1)")} end as v0, case when k > 0 then {_T("k", f"({points} - 1)")} end as v1 from range({points}) t(k)),
grid as (select k, case when k = 0 then 0.0 else (v0 + v1) / 2 end as f,
  case when k = 0 then ln(0.9) else ln(0.1 * ({high} - {low} + pow(v1, {b}) - pow(v0, {b}))) end as lpf from bounds)
"""


_PHRED = """
phred as (select chrom, sample, pos, n, case when base = major then 1 - e else e / 3 end as p_major,
  case when base = case when minor <> 'N' then minor when major = 'A' then 'C' else 'A' end then 1 - e else e / 3 end as p_minor
  from (select chrom, sample, refpos as pos, bq, letter as base, count(*) as n, pow(10.0, -bq / 10.0) as e from calls where bq >= 20 group by 1, 2, 3, 4, 5) join alleles using (chrom, sample, pos)),
likely as (select chrom, sample, pos, k, f, lpf, sum(n * ln(f * p_minor + (1 - f) * p_major)) as loglik from phred, grid group by 1, 2, 3, 4, 5, 6),
joint as (select *, lpf + loglik as log_joint, max(lpf + loglik) over (partition by chrom, sample, pos) as top from likely),
post as (select *, log_joint - (top + ln(sum(exp(log_joint - top)) over (partition by chrom, sample, pos))) as log_post from joint)
"""
_COEF = """
coef as (select ['A', 'C', 'G', 'T'][1 + i // 12] as base, (1 + (i // 6) % 2)::int as read_num, ((i // 2) % 3)::int as outcome, (i % 2)::int as col, ((i * 7) % 11 - 5) / 10.0::double as b from range(48) t(i)),
labelled as (select chrom, sample, pos, is_reverse, read_num, true_base as base, dend_bin, n_a, n_c, n_g, n_t from (select *, case when is_reverse = 1 then translate(major, 'ACGT', 'TGCA') else major end as true_base from
  (select chrom, sample, pos, is_reverse, read_num, dend_bin, context, contam_a, contam_c, contam_g, contam_t, major, minor, """ + _COUNTS + """ from observed group by all)))
"""
_SCORED = """
kinds as (select distinct base, read_num, dend_bin from labelled),
odds as (select k.base, k.read_num, k.dend_bin, outcome, sum(b * case when col = 0 then 1.0 else dend_bin / 10.0 end) as o from kinds k join coef c on k.base = c.base and k.read_num = c.read_num group by 1, 2, 3, 4),
wide as (select base, read_num, dend_bin, max(o) filter (outcome = 0) as o0, max(o) filter (outcome = 1) as o1, max(o) filter (outcome = 2) as o2 from odds group by 1, 2, 3),
lp as (select base, read_num, dend_bin, o0 - t as lp_a, o1 - t as lp_c, o2 - t as lp_g, -t as lp_t from (select *, ln(exp(o0) + exp(o1) + exp(o2) + 1) as t from wide)),
scored as (select * from labelled join lp using (base, read_num, dend_bin))
"""


def _network() -> str:
    layers, rows = [], 7
    for k, cols in enumerate((32, 16, 4)):
        before = "inputs" if k == 0 else f"out{k - 1}"
        total = f"sum(v * (((3 * i + 5 * j + 7 * {k}) % 13 - 6) / 20.0::double)) + (((j + {k}) % 5 - 2) / 10.0::double)"
        value = total if k == 2 else f"greatest({total}, 0) + ln(1 + exp(-abs({total})))"
        layers.append(f"out{k} as (select dend_bin, read_num, base, j as i, {value} as v from {before}, range({cols}) t(j) group by 1, 2, 3, 4)")
        rows = cols
    inputs = "inputs as (select dend_bin, read_num, base, i, case i when 0 then 1.0 when 1 then dend_bin / 10.0 when 2 then read_num - 1 else case when base = substr('ACGT', (i - 2)::int, 1) then 1 else 0 end end::double as v from (select distinct dend_bin, read_num, base from labelled), range(7) t(i))"
    return ",\n".join([inputs, *layers])


def sql() -> dict[str, str]:
    base = "with " + _READS
    alleles = f"{base}, {_ALLELES}"
    sites = f"{alleles}, {_SITES}"
    observed, coarse = f"{sites}, {_observed(2)}", f"{sites}, {_observed(1)}"
    post = f"{alleles}, {_grid('16')}, {_PHRED}"
    model = f"{coarse}, {_COEF}"
    per = "chrom, sample, pos"
    norm = lambda c: f"round(({c} - min({c}) over ())::double / (max({c}) over () - min({c}) over ()), 6) as {c}"
    grad = ", ".join(f"{{'outcome': {o}, 'd': n_{b} - (n_a + n_c + n_g + n_t) * exp(lp_{b})}}" for o, b in enumerate("acg"))
    varied = "with " + _VARIED
    inside = "case when is_reverse = 1 then qpos < alen - 2 else qpos >= 2 end"
    return {
        "walked_calls": f"{varied} select chrom, sample, refpos as pos, is_reverse, read_num, {_ORIENTED} as base, {_context(2)} as context, dend, count(*) as n, sum(qpos)::bigint as sum_qpos, sum(bq)::bigint as sum_bq from calls where bq >= 20 and mapq >= 20 and letter <> 'N' and {inside} and not contains({_context(2)}, 'N') group by all",
        "varied_pileup": f"{varied} select chrom, sample, refpos as pos, " + ", ".join(f"count(*) filter (letter = '{b}') as n_{b.lower()}" for b in "ACGT") + " from calls where bq >= 20 and letter <> 'N' group by 1, 2, 3",
        "base_calls_filtered": f"{base} select sample, chrom, refpos, is_reverse, read_num, {_ORIENTED} as base, {_context(2)} as context, count(*) as n, sum(bq)::bigint as sum_bq, sum(mapq)::bigint as sum_mq from calls where mapq >= 20 and bq >= 20 and {_inside(2)} group by all",
        "complement_bases": f"{base} select distinct seq, translate(seq, 'ACGT', 'TGCA') as complement, translate(substr(seq, 1, 1), 'ACGT', 'TGCA') as first, (instr('ACGT', substr(seq, 1, 1)) - 1)::int as first_index from reads",
        "read_context": f"{base} select {_context(3)} as context, is_reverse, qpos, count(*) as n from calls where {_inside(3)} group by all",
        "distance_binned": f"{base} select is_reverse, dend, (floor((dend + 5) / 10.0) * 10)::int as by_10, (floor((dend + 2.5) / 5.0) * 5)::int as by_5, count(*) as n from calls group by all",
        "pileup_counts": f"{base} select * from pile",
        "pileup_strand_merge": f"{base} select * from pile",
        "consensus_calls": f"{base} select {per}, {_CONSENSUS.format(n=20)} as consensus, {_CONSENSUS.format(n=120)} as consensus_120 from pile",
        "major_minor": f"{alleles} select * from alleles",
        "base_frequencies": f"{base} select {per}, " + ", ".join(f"round(n_{b} / greatest(n_a + n_c + n_g + n_t, 1)::double, 6) as f_{b}" for b in "acgt") + " from pile",
        "candidate_sites": f"{base} select {per} from pile where " + " + ".join(f"(n_{b} / greatest(n_a + n_c + n_g + n_t, 1)::double > 0.02)::int" for b in "acgt") + " > 1",
        "contamination_fractions": f"{sites} select * from contam",
        "region_bins": f"{base} select chrom, sample, bin::int as bin, count(*) as n from (select chrom, sample, unnest(range(pos // 50, (pos + {LENGTH - 1}) // 50 + 1)) as bin from reads) group by all",
        "covariate_rows": f"{observed} select distinct (1 + 3 + 4 + 15 + 2)::int as width, 1.0::double as const, bq::double as bq, mapq::double as mq, dend_bin::double as dend, contam_a as contamA, contam_c as contamC, contam_g as contamG, contam_t as contamT, ((instr('ACGT', context[1]) - 1) * 4 + instr('ACGT', context[2]) - 1)::double as context_code, right(sample, 1)::double as sample_code from observed",
        "covariate_dictionary": f"{observed} select {_KEYS}, {_COUNTS} from observed group by {_KEYS}",
        "collapsed_observations": f"{observed} select chrom, pos, is_reverse, read_num, {_KEYS}, major, minor, {_COUNTS} from observed group by all",
        "local_row_ids": f"{coarse} select *, (row_number() over (partition by {per} order by is_reverse, read_num, {_COARSE}) - 1)::int as local_id from (select distinct {per}, is_reverse, read_num, {_COARSE} from observed)",
        "variable_columns": f"{observed}, s as (" + " union all ".join(f"select '{c}' as name, min({c})::double as low, max({c})::double as high, count(distinct {c}) as kinds from (select *, 1 as const, 1 as unit, 0 as zero from observed)" for c in ("const", "bq", "mapq", "dend_bin", "contam_a", "contam_c", "contam_g", "contam_t", "unit", "zero")) + ") select * from s where kinds > 1 or name = 'const'",
        "minmax_normalized": f"{observed} select {norm('bq')}, {norm('mapq')}, {norm('dend_bin')} from (select distinct bq, mapq, dend_bin from observed)",
        "locus_key_parity": f"{observed}, m as (select {per} from pile except select {per} from observed) select 'left' as side, count(*) as n, sum(pos)::bigint as sum_pos from m having count(*) > 0",
        "dense_positions": f"{base} select e.chrom, e.sample, e.pos, " + ", ".join(f"coalesce(n_{b}, 0) as n_{b}" for b in "acgt") + " from (select chrom, sample, unnest(range(max(pos) + 5))::int as pos from pile group by 1, 2) e left join pile using (chrom, sample, pos)",
        "global_row_ids": f"{coarse} select {per}, is_reverse, read_num, dense_rank() over (order by {', '.join(c + ' nulls first' for c in _COARSE.split(', '))}) - 1 as cov_id, {_COUNTS} from observed group by {per}, is_reverse, read_num, {_COARSE}",
        "limited_reads": f"{base} select sample, least(count(*), 1500)::bigint as n from reads group by sample",
        "dense_covariates": f"{coarse}, d as (select distinct {per}, {_COARSE} from observed), k as (select {per}, count(*) as n, sum(dend_bin) as s from d group by {per}), e as (select chrom, sample, unnest(range(max(pos) + 5))::int as pos from pile group by 1, 2) select chrom, sample, (pos // 100)::int as tile, string_agg(coalesce(n, 0)::varchar, ',' order by pos) as sizes, coalesce(sum(s), 0)::bigint as sum_dend from e left join k using (chrom, sample, pos) group by 1, 2, 3",
        "nested_observations": f"{coarse}, o as (select {per}, is_reverse, read_num, {_COARSE}, {_COUNTS} from observed group by {per}, is_reverse, read_num, {_COARSE}), l as (select *, (row_number() over (partition by {per} order by is_reverse, read_num, {_COARSE}) - 1)::int as local_id from o) select {per}, " + ", ".join(f"coalesce(list(concat_ws(':', local_id, n_a, n_c, n_g, n_t) order by local_id) filter (is_reverse = {r} and read_num = {k}), []) as {n}" for n, r, k in (("f1", 0, 1), ("f2", 0, 2), ("r1", 1, 1), ("r2", 1, 2))) + f" from l group by {per}",
        "freq_grid": f"{base}, n as (select count(distinct pos) as n from reads), v as (select k::int as k, n, {_T('(k - 1)', '(n - 1)')} as v0, {_T('k', '(n - 1)')} as v1 from n, range(401) t(k) where k < n), g as (select k, case when k = 0 then 0.0 else (v0 + v1) / 2 end as f from v) select k, round(f, 9) as f, case when k > 0 then round(ln(f), 9) end as log_f, round(ln(1 - f), 9) as log_1mf from g",
        "prior_logprob": f"{base}, m as (select sample, round(avg(n_a + n_c + n_g + n_t) / 10) as b from pile group by 1), bounds as (select k::int as k, {_T('(k - 1)', '15')} as v0, {_T('k', '15')} as v1 from range({_POINTS}) t(k)) select sample, k, round(case when k = 0 then ln(0.9) else ln(0.1 * (pow(1 - v0, b) - pow(1 - v1, b) + pow(v1, b) - pow(v0, b))) end, 8) as lpf from m, bounds",
        "multinomial_loglik": f"{model}, {_SCORED} select round(sum(n_a * lp_a + n_c * lp_c + n_g * lp_g + n_t * lp_t), 4) as loglik from scored",
        "multinomial_gradient": f"{model}, {_SCORED}, parts as (select base, read_num, dend_bin, unnest([{grad}]) as o from scored) select base, read_num, (o.outcome)::int as outcome, col::int as col, round(sum(o.d * case when col = 0 then 1.0 else dend_bin / 10.0 end), 4) as g from parts, range(2) t(col) group by all",
        "nn_forward": f"{model}, {_network()} select dend_bin, read_num, base, " + ", ".join(f"round(max(v) filter (i = {i}) - ln(sum(exp(v))), 6) as lp_{b}" for i, b in enumerate("acgt")) + " from out2 group by 1, 2, 3",
        "grid_loglik": f"{post} select {per}, k, round(loglik, 6) as loglik from likely",
        "posterior": f"{post} select {per}, k, round(log_joint, 6) as log_joint, round(log_post, 6) as log_post from post",
        "map_frequency": f"{post} select {per}, k as best_k, round(f, 6) as best_freq, round(log_post, 6) as log_post from post qualify row_number() over (partition by {per} order by log_post desc, k) = 1",
        "global_loss": f"{post}, ev as (select {per}, max(top) + ln(sum(exp(log_joint - top))) as e from joint group by 1, 2, 3) select round(-avg(e), 5) as loss, count(*) as sites from ev",
        "posterior_table": f"{post} select {per}, k, format('{{:.8e}}', round(log_post, 3)) as log_post from post",
        "posterior_lines": f"{post} select {per}, format('{{:.8e}}', round((list(f order by log_post desc, k))[1], 6)) as best_freq, list(format('{{:.8e}}', round(log_post, 3)) order by k) as log_post from post group by {per}",
    }
