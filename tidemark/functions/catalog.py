"""The operator catalogue: number, signature and how Spark runs each operator.

Classes: E column expression, A aggregate, W window, J join on position keys, F higher-order function,
K grouped Arrow kernel, R rewrite; combinations take more than one of these steps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Operator numbers, names and parameters.
_OPERATORS = """
1 add(lhs, rhs) E
2 subtract(lhs, rhs) E
3 multiply(lhs, rhs) E
4 divide(numerator, denominator) E
5 power(base, exponent) E
6 minimum(lhs, rhs) E
7 maximum(lhs, rhs) E
8 negate(values) E
9 absolute(values) E
10 sqrt(values) E
11 clip(values, lower, upper) E
12 log(values) E
13 exp(values) E
14 reciprocal(values) E
15 sign(values) E
16 equal(lhs, rhs) E
17 not_equal(lhs, rhs) E
18 less_than(lhs, rhs) E
19 less_equal(lhs, rhs) E
20 greater_than(lhs, rhs) E
21 greater_equal(lhs, rhs) E
22 logical_and(lhs, rhs) E
23 logical_or(lhs, rhs) E
24 logical_not(values) E
25 where(mask, if_true, if_false) E
26 sum_where(values, mask) A
27 mean_where(values, mask) A
28 variance_where(values, mask) A
29 std_where(values, mask) A
30 min_where(values, mask) A
31 max_where(values, mask) A
32 median_where(values, mask) A
33 quantile_where(values, mask, probability) A
34 count_true(mask) A
35 max_consecutive_true(values) W+A
36 sum(values) A
37 product(values) A
38 mean(values) A
39 min_value(values) A
40 max_value(values) A
41 variance(values[, ddof]) A
42 std(values[, ddof]) A
43 cumulative_sum(values) W
44 cumulative_product(values) W
45 cumulative_return(values) W
46 cumulative_max(values) W
47 cumulative_min(values) W
48 drawdown_series(levels) W
49 new_high_mask(levels) W
50 rolling_mean(values, window[, min_periods]) W
51 rolling_std(values, window[, ddof][, min_periods]) W
52 rolling_min(values, window[, min_periods]) W
53 rolling_max(values, window[, min_periods]) W
54 recursive_smooth(values, periods, initial) K
55 divide_or_default(numerator, denominator, default) E
56 first(values) A
57 length(values) A
58 lag(values[, periods]) W
59 difference(values[, periods]) W
60 median(values) A
61 skewness(values) A
62 excess_kurtosis(values) A
63 mean_absolute_deviation(values) A
64 root_mean_square(values) A
65 argmin(values) A
66 argmax(values) A
67 quantile(values, probability) A
68 linear_slope(x[, y]) A
69 linear_intercept(x[, y]) A
70 linear_r_squared(x[, y]) A
71 regression_standard_error(x[, y]) A
72 normal_pdf(values) E
73 normal_ppf(probability) E
74 last(values) A
75 total_return(values) A
76 annualized_return(returns, periods_per_year) A
77 sum_time(values) A
78 mean_time(values) A
79 product_time(values) A
80 variance_time(values) A
81 std_time(values) A
82 min_time(values) A
83 max_time(values) A
84 sum_asset(values) A
85 mean_asset(values) A
86 product_asset(values) A
87 variance_asset(values) A
88 std_asset(values) A
89 min_asset(values) A
90 max_asset(values) A
91 transpose(values) E
92 dot(lhs, rhs) A
93 outer(lhs, rhs) E
94 matmul(lhs_matrix, rhs_matrix) A/K
95 matvec(matrix, vector) A
96 diag(values) E
97 trace(values) A
98 solve(matrix, rhs) K
99 covariance(lhs[, rhs]) A
100 correlation(lhs[, rhs]) A
101 portfolio_returns(asset_returns, asset_weights) A
102 quadratic_form(vector, matrix) A
103 active_returns(lhs, rhs) R
104 last_drawdown_interval(drawdowns) W+A
105 interval_start(interval) E
106 interval_trough(interval) E
107 interval_recovery(interval) E
108 value_at(values, position) A
109 days_between(start_date, end_date) E
110 require_positive(values) E
111 require_nonnegative(values) E
112 linear_fit(x[, y]) A
113 fit_slope(fit) E
114 fit_intercept(fit) E
115 fit_residual_sum_squares(fit) E
116 fit_total_sum_squares(fit) E
117 fit_observation_count(fit) E
118 finite_mask(values) E
119 normal_cdf(values) E/K
120 aligned_shift(values[, periods][, fill]) W
121 recursive_filter(values, alpha, initial, update_mask[, seed_mode][, emit_policy]) K
122 argsort(values) W
123 gather(values, indices) W
124 distinct_count(identifiers[, mask]) A
125 floor(values) E
126 cos(values) E
127 recursive_filter_adaptive(values, alpha, update_mask, reset_mask[, initial][, seed_mode][, min_periods][, emit_policy]) K
128 linear_filter2(values, b0, b1, a1, a2, reset_mask[, min_periods][, bootstrap]) K
129 scalar_kalman(values, process_variance, measurement_variance[, initial_variance]) K
130 state_estimate(state) E
131 state_variance(state) E
132 state_hysteresis(values, upper_enter, upper_exit, lower_enter, lower_exit) K
133 state_confirm(codes, confirmation, min_hold) K
134 state_continuous(candidate, initial, observed, confirmation, state_count) K
135 continuous_state_values(state) E
136 continuous_state_evidence(state) E
137 continuous_state_pending(state) E
138 drawdown_cycle_state(price, drawdown, valid, stress, rebound, exit) K
139 local_extrema(price, left, right, head, tail) W+K
140 ps_filter(price, events, min_phase, min_cycle, amplitude) K
141 between_events(events) W
142 segment_starts(segments) E
143 segment_ends(segments) E
144 phase_direction(events, segments) W
145 drawdown_cycle_reference(phases, changes, segments, stress) W
146 state_select(condition, when_true, when_false, valid) E
147 cholesky(matrix) K
148 solve_multi(matrix, rhs) K
149 triangular_solve(matrix, rhs[, lower][, unit_diagonal]) K
150 symmetric_eigh(matrix[, tolerance][, max_sweeps]) K
151 eigenvalues(decomposition) E
152 eigenvectors(decomposition) E
153 take_axis(values, indices, axis) J
154 slice_axis(values, axis, start, stop, step) E
155 concatenate(lhs, rhs, axis) E
156 stack(lhs, rhs, axis) E
157 broadcast_like(values, template) J
158 sum_axis(values, axis) A
159 mean_axis(values, axis) A
160 swap_axes(values, axis1, axis2) E
161 variance_axis(values, axis[, ddof]) A
162 max_axis(values, axis) A
163 argmax_axis(values, axis) A
164 logsumexp_axis(values, axis) W+A
165 softmax_axis(values, axis) W
166 gaussian_log_density(values, means, variances) A
167 gaussian_mixture_em(values, weights, means, variances[, max_iterations][, tolerance]) K
168 gaussian_hmm_em(values, initial, transition, means, variances[, max_iterations][, tolerance]) K
169 mixture_weights(model) E
170 mixture_means(model) E
171 mixture_variances(model) E
172 em_iterations(model) E
173 em_log_likelihood(model) E
174 em_converged(model) E
175 hmm_initial(model) E
176 hmm_transition(model) E
177 hmm_means(model) E
178 hmm_variances(model) E
179 hmm_filter(log_emissions, initial, transition[, predict_first]) K
180 hmm_smooth(log_emissions, initial, transition) K
181 transition_counts(codes, states) W+A
182 one_hot(codes, states) E
183 partition_mean(values, order, partitions) W+A
184 sample_unique_indices(template, count[, seed]) K
185 scatter_rows(values, indices, length[, fill]) J
186 affine_contract(values, coefficients, initial) A/F
187 expm1(values) E
188 cumulative_product_axis(values, axis, initial) W
189 cumulative_max_axis(values, axis, initial) W
190 quantiles_axis(values, probabilities, axis) A
"""

#: Other names of operators.
_ALIASES = """
abs absolute
corr correlation
cov covariance
cumulative_maximum cumulative_max
cumulative_minimum cumulative_min
elementwise_max maximum
elementwise_min minimum
eq equal
ge greater_equal
gt greater_than
kurtosis_excess excess_kurtosis
le less_equal
lt less_than
mad mean_absolute_deviation
masked_count count_true
masked_max max_where
masked_mean mean_where
masked_median median_where
masked_min min_where
masked_quantile quantile_where
masked_std std_where
masked_sum sum_where
masked_variance variance_where
max max_value
min min_value
mul multiply
ne not_equal
prod product
rms root_mean_square
safe_divide divide
sequence_mean mean
sequence_prod product
sequence_std std
sequence_sum sum
skew skewness
sub subtract
var variance
"""


@dataclass(frozen=True)
class Operator:
    number: int
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    kind: str

    def accepts(self, n: int) -> bool:
        return len(self.required) <= n <= len(self.required) + len(self.optional)


def _parse(line: str) -> Operator:
    m = re.fullmatch(r"(\d+) (\w+)\((.*)\) (\S+)", line)
    required, *optional = re.split(r"\[, ?", m[3])
    names = tuple(x.strip() for x in required.split(",") if x.strip())
    return Operator(int(m[1]), m[2], names, tuple(x.strip(" ]") for x in optional), m[4])


CATALOG: dict[str, Operator] = {o.name: o for o in map(_parse, _OPERATORS.strip().splitlines())}
ALIASES: dict[str, str] = dict(line.split() for line in _ALIASES.strip().splitlines())


def resolve(name: str) -> Operator:
    """The operator of a name or alias; KeyError if there is none."""
    return CATALOG[ALIASES.get(name, name)]
