"""One DuckDB statement per registered query."""

from __future__ import annotations

from jobmargin.catalog import CAUSES, CHECKSUM_PRIME, NOTE_TYPE, PROJECT, SEARCH, WORDS
from jobmargin.plans import leaks
from jobmargin.sources.schemas import DOMAINS, REFERENCES, TABLES
from oracle.tables import with_tables

COST = "(hours_st + hours_ot * 1.5) * hourly_rate * burden_multiplier"
HOURS = "hours_st + hours_ot"
BID = "estimated_labor_cost + estimated_material_cost + estimated_equipment_cost + estimated_sub_cost"
SCOPE = "estimated_labor_hours * 85 + estimated_material_cost"
PENDING = "status IN ('Pending', 'Under Review')"
RECOVERABLE = "responsibility IN ('owner', 'gc') AND co_status = 'not_submitted'"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def i(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def r(x: str, digits: int = 6) -> str:
    """Rounded without a negative zero; left alone where a double has no such digits."""
    return f"(CASE WHEN abs({x}) < 1e9 THEN round({x}, {digits}) + 0.0 ELSE {x} END)"


def total(x: str, scale: int = 2) -> str:
    return f"CAST(sum({x}) AS DECIMAL(28,{scale}))"


def share(num: str, den: str, guard: str = "<>") -> str:
    return f"CASE WHEN {den} {guard} 0 THEN {d(num)} / {d(den)} ELSE 0.0 END"


def over(num: str, den: str) -> str:
    return f"{d(num)} / ({d(den)} + 1e-9)"


def dollars(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {d(f'round({x}, 2)')})"


def percent(x: str) -> str:
    return f"printf('%.1f', round(({x}) * 100, 1)) || '%'"


def week_end(x: str) -> str:
    return f"({x} + CAST(7 - isodow({x}) AS INTEGER))"


def columns(names, money=(), ints=()) -> str:
    return ", ".join(
        f"{d(n)} AS {n}" if n in money else f"{i(n)} AS {n}" if n in ints else n for n in names
    )


HELPERS: dict[str, str] = {
    "p_labor": f"SELECT project_id, {total(COST, 6)} AS labor, {total(HOURS)} AS hours FROM labor_logs GROUP BY 1",
    "p_material": f"SELECT project_id, {total('total_cost')} AS material FROM material_deliveries GROUP BY 1",
    "p_budget": f"""SELECT project_id, {total(BID)} AS bid_cost, {total('estimated_labor_cost')} AS b_labor,
        {total('estimated_material_cost')} AS b_material, {total('estimated_equipment_cost')} AS b_equipment,
        {total('estimated_sub_cost')} AS b_sub, {i('sum(estimated_labor_hours)')} AS b_hours
        FROM sov_budget GROUP BY 1""",
    "last_bills": """SELECT * FROM billing_history JOIN (SELECT project_id, max(application_number) AS application_number
        FROM billing_history GROUP BY 1) USING (project_id, application_number)""",
    "last_lines": """SELECT * FROM billing_line_items JOIN (SELECT project_id,
        max(application_number) AS application_number FROM billing_line_items GROUP BY 1)
        USING (project_id, application_number)""",
    "p_co": f"""SELECT project_id, count(*) AS total_cos,
        count(*) FILTER (WHERE status = 'Approved') AS approved_count,
        count(*) FILTER (WHERE {PENDING}) AS pending_count,
        count(*) FILTER (WHERE status = 'Rejected') AS rejected_count,
        coalesce(sum(amount) FILTER (WHERE status = 'Approved'), 0) AS approved_amount,
        coalesce(sum(amount) FILTER (WHERE {PENDING}), 0) AS pending_amount
        FROM change_orders GROUP BY 1""",
    "p_scope": f"""SELECT project_id, count(*) AS scope_count,
        count(*) FILTER (WHERE {RECOVERABLE}) AS recoverable_count,
        coalesce(sum({SCOPE}) FILTER (WHERE {RECOVERABLE}), 0) AS recoverable_cost
        FROM scope_creep_candidates GROUP BY 1""",
    "p_all": """SELECT c.project_id, c.project_name, c.original_contract_value AS value, c.gc_name,
        c.substantial_completion_date, coalesce(bid_cost, 0) AS bid, coalesce(labor, 0) AS labor,
        coalesce(material, 0) AS material, coalesce(labor, 0) + coalesce(material, 0) AS cost,
        coalesce(cumulative_billed, 0) AS billed, coalesce(b_labor, 0) AS b_labor
        FROM contracts c LEFT JOIN p_budget USING (project_id) LEFT JOIN p_labor USING (project_id)
        LEFT JOIN p_material USING (project_id) LEFT JOIN last_bills USING (project_id)""",
    "l_labor": f"""SELECT project_id, sov_line_id, {total(COST, 6)} AS labor, {total(HOURS)} AS hours
        FROM labor_logs GROUP BY 1, 2""",
    "l_material": f"""SELECT project_id, sov_line_id, {total('total_cost')} AS material
        FROM material_deliveries GROUP BY 1, 2""",
    "l_all": """SELECT s.project_id, s.sov_line_id, s.line_number, s.description, s.scheduled_value AS value,
        coalesce(labor, 0) AS labor, coalesce(material, 0) AS material,
        coalesce(labor, 0) + coalesce(material, 0) AS cost, coalesce(total_billed, 0) AS billed
        FROM sov s LEFT JOIN l_labor USING (project_id, sov_line_id)
        LEFT JOIN l_material USING (project_id, sov_line_id)
        LEFT JOIN (SELECT project_id, sov_line_id, total_billed FROM last_lines) USING (project_id, sov_line_id)""",
    "summaries": f"""SELECT project_id, project_name, {d('value')} AS original_contract_value, gc_name,
        substantial_completion_date, {d('bid')} AS bid_cost, {share('value - bid', 'value', '>')} AS bid_margin_pct,
        {d('billed')} AS total_billed, {d('labor')} AS actual_labor_cost, {d('material')} AS actual_material_cost,
        {share('billed - cost', 'billed', '>')} AS realized_margin_pct,
        coalesce(pct_complete, 0.0) AS pct_complete, coalesce(approved_count, 0) AS approved_cos,
        coalesce(pending_count, 0) AS pending_cos, coalesce(scope_count, 0) AS scope_creep_count
        FROM p_all LEFT JOIN p_co USING (project_id) LEFT JOIN p_scope USING (project_id)
        LEFT JOIN (SELECT project_id, avg({d('pct_complete')}) AS pct_complete FROM last_lines GROUP BY 1)
        USING (project_id)""",
    "labor_lines": """SELECT b.project_id, project_name, b.sov_line_id, line_number, s.description,
        estimated_labor_hours AS budgeted_hours, coalesce(hours, 0) AS actual_hours,
        estimated_labor_cost AS budgeted_cost, coalesce(labor, 0) AS actual_cost,
        coalesce(labor, 0) > estimated_labor_cost * 1.1 AS flagged
        FROM sov_budget b JOIN sov s ON s.sov_line_id = b.sov_line_id
        JOIN contracts c ON c.project_id = b.project_id
        LEFT JOIN l_labor l ON l.sov_line_id = b.sov_line_id AND l.project_id = b.project_id""",
    "overruns": f"""SELECT project_id, project_name, sov_line_id, {i('line_number')} AS line_number, description,
        {d('budgeted_hours')} AS budgeted_hours, {d('actual_hours')} AS actual_hours,
        {d('actual_hours - budgeted_hours')} AS hours_variance,
        {r(share('actual_hours - budgeted_hours', 'budgeted_hours'))} AS hours_overrun_pct,
        {d('budgeted_cost')} AS budgeted_cost, {d('actual_cost')} AS actual_cost,
        {d('actual_cost - budgeted_cost')} AS cost_variance,
        {r(share('actual_cost - budgeted_cost', 'budgeted_cost'))} AS cost_overrun_pct, flagged
        FROM labor_lines""",
    "alerts": f"""
        SELECT 'scope_creep' AS type, CASE WHEN recoverable_cost > 50000 THEN 'high' ELSE 'medium' END AS severity,
            project_id, project_name, CAST(recoverable_count AS VARCHAR) || ' unsubmitted scope creep item(s) totaling '
            || {dollars('recoverable_cost')} AS message, {d('recoverable_cost')} AS amount
        FROM p_scope JOIN contracts USING (project_id) WHERE recoverable_count > 0
        UNION ALL
        SELECT 'labor_overrun', CASE WHEN b_labor <> 0 AND labor - b_labor > b_labor * 0.2 THEN 'high' ELSE 'medium' END,
            project_id, project_name, 'Labor cost ' || {dollars('labor')} || ' exceeds budget ' || {dollars('b_labor')}
            || ' by ' || {percent(share('labor - b_labor', 'b_labor'))}, {d('labor - b_labor')}
        FROM p_all WHERE labor > b_labor * 1.1
        UNION ALL
        SELECT 'billing_lag', CASE WHEN cost - billed > billed * 0.2 THEN 'high' ELSE 'medium' END,
            project_id, project_name, 'Costs exceed billing by ' || {percent(share('cost - billed', 'billed'))}
            || ' — actual ' || {dollars('cost')} || ' vs billed ' || {dollars('billed')}, {d('cost - billed')}
        FROM p_all WHERE billed > 0 AND cost - billed > billed * 0.1
        UNION ALL
        SELECT 'pending_co', 'high', project_id, project_name, CAST(pending_count AS VARCHAR)
            || ' pending change order(s) totaling ' || {dollars('pending_amount')}, {d('pending_amount')}
        FROM p_co JOIN contracts USING (project_id) WHERE pending_amount > 100000""",
    "load_before": "SELECT * FROM change_orders WHERE NOT ends_with(co_number, '33')",
    "load_after": """SELECT * REPLACE (CASE WHEN ends_with(co_number, '55') THEN amount + 1 ELSE amount END AS amount)
        FROM change_orders WHERE NOT ends_with(co_number, '77')""",
    "load_gone": "SELECT DISTINCT project_id, co_number FROM (SELECT * FROM load_before EXCEPT SELECT * FROM load_after)",
    "load_come": "SELECT DISTINCT project_id, co_number FROM (SELECT * FROM load_after EXCEPT SELECT * FROM load_before)",
    "last_period": "SELECT project_id, max(period_end) AS last_period_end FROM billing_history GROUP BY 1",
    "labor_kept": "SELECT * FROM labor_logs JOIN last_period USING (project_id) WHERE date <= last_period_end",
    "material_kept": """SELECT * FROM material_deliveries JOIN last_period USING (project_id)
        WHERE date <= last_period_end""",
    "labor_w": f"""SELECT project_id, sov_line_id, {week_end('date')} AS week_end, {total(HOURS)} AS labor_hours_w,
        {total(COST, 6)} AS labor_cost_w, {total('hours_st')} AS st_hours_w, {total('hours_ot')} AS ot_hours_w
        FROM labor_kept GROUP BY 1, 2, 3""",
    "labor_w_uncut": f"""SELECT project_id, sov_line_id, {week_end('date')} AS week_end,
        {total(HOURS)} AS labor_hours_w, {total(COST, 6)} AS labor_cost_w, {total('hours_st')} AS st_hours_w,
        {total('hours_ot')} AS ot_hours_w FROM labor_logs GROUP BY 1, 2, 3""",
    "material_w": f"""SELECT project_id, sov_line_id, {week_end('date')} AS week_end,
        {total('total_cost')} AS material_cost_w, {i('sum(quantity)')} AS material_qty_w
        FROM material_kept GROUP BY 1, 2, 3""",
    "billing_w": f"""SELECT li.project_id, sov_line_id, {week_end('bh.period_end')} AS week_end,
        max(pct_complete) AS pct_complete, max(total_billed) AS total_billed,
        max(scheduled_value) AS scheduled_value, arg_min(description, li.application_number) AS description
        FROM billing_line_items li JOIN billing_history bh
        ON li.project_id = bh.project_id AND li.application_number = bh.application_number GROUP BY 1, 2, 3""",
    "drift_w": """SELECT project_id, sov_line_id, week_end, labor_cost_w, estimated_labor_cost AS budget,
        earned_labor_cost_td - coalesce(lag(earned_labor_cost_td) OVER (PARTITION BY project_id, sov_line_id ORDER BY week_end), 0) AS earned_w
        FROM earned WHERE estimated_labor_cost > 0""",
    "drift_walk": """SELECT *, sum(labor_cost_w - earned_w - budget * 0.01) OVER (PARTITION BY project_id, sov_line_id ORDER BY week_end) AS walk,
        sum(labor_cost_w) OVER recent AS cost_4w, sum(earned_w) OVER recent AS earned_4w FROM drift_w
        WINDOW recent AS (PARTITION BY project_id, sov_line_id ORDER BY week_end RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW)""",
    "drift_excess": """SELECT *, walk - least(0, min(walk) OVER (PARTITION BY project_id, sov_line_id ORDER BY week_end)) AS excess FROM drift_walk""",
    # The present excess began in the week after the last one without any.
    "drift": f"""SELECT e.*, CASE WHEN excess > 0 THEN (SELECT min(b.week_end) FROM drift_excess b WHERE b.project_id = e.project_id
            AND b.sov_line_id = e.sov_line_id AND b.week_end <= e.week_end AND b.week_end > coalesce((SELECT max(z.week_end)
                FROM drift_excess z WHERE z.project_id = e.project_id AND z.sov_line_id = e.sov_line_id AND z.excess = 0
                AND z.week_end <= e.week_end), DATE '0001-01-01')) END AS since,
        CASE WHEN earned_4w <> 0 THEN {d('cost_4w')} / {d('earned_4w')} END AS burn_4w FROM drift_excess e""",
    "labor_w_td": """SELECT *, sum(labor_cost_w) OVER (PARTITION BY project_id, sov_line_id ORDER BY week_end) AS cost_td
        FROM labor_w_uncut""",
    "over_w": """SELECT w.*, estimated_labor_cost AS budget, cost_td > estimated_labor_cost * 1.1 AS over
        FROM labor_w_td w JOIN sov_budget b ON b.project_id = w.project_id AND b.sov_line_id = w.sov_line_id""",
    "over_islands": """SELECT *, row_number() OVER (PARTITION BY project_id, sov_line_id ORDER BY week_end)
            - row_number() OVER (PARTITION BY project_id, sov_line_id, over ORDER BY week_end) AS island FROM over_w""",
    "periods": f"""SELECT project_id, sov_line_id, min(week_end) - 6 AS over_from, max(week_end) AS over_to,
        {d('max(cost_td - budget)')} AS overrun FROM over_islands WHERE over GROUP BY project_id, sov_line_id, island""",
    "spine": """SELECT project_id, sov_line_id, week_end FROM labor_w
        UNION SELECT project_id, sov_line_id, week_end FROM material_w
        UNION SELECT project_id, sov_line_id, week_end FROM billing_w""",
    "fact_w": """SELECT project_id, sov_line_id, week_end, coalesce(labor_hours_w, 0) AS labor_hours_w,
        coalesce(labor_cost_w, 0) AS labor_cost_w, coalesce(st_hours_w, 0) AS st_hours_w,
        coalesce(ot_hours_w, 0) AS ot_hours_w, coalesce(material_cost_w, 0) AS material_cost_w,
        coalesce(material_qty_w, 0) AS material_qty_w,
        CAST(greatest(0, least(100, coalesce(pct_complete, 0))) AS DECIMAL(5,2)) AS pct_complete,
        coalesce(total_billed, 0) AS total_billed, coalesce(scheduled_value, 0) AS scheduled_value,
        coalesce(description, '') AS description
        FROM spine LEFT JOIN labor_w USING (project_id, sov_line_id, week_end)
        LEFT JOIN material_w USING (project_id, sov_line_id, week_end)
        LEFT JOIN billing_w USING (project_id, sov_line_id, week_end)""",
    "fact_td": """SELECT *,
        CAST(sum(labor_hours_w) OVER w AS DECIMAL(28,2)) AS labor_hours_td,
        CAST(sum(labor_cost_w) OVER w AS DECIMAL(28,6)) AS labor_cost_td,
        CAST(sum(material_cost_w) OVER w AS DECIMAL(28,2)) AS material_cost_td,
        CAST(sum(st_hours_w) OVER w AS DECIMAL(28,2)) AS st_hours_td,
        CAST(sum(ot_hours_w) OVER w AS DECIMAL(28,2)) AS ot_hours_td,
        max(pct_complete) OVER w AS pct_complete_td, max(total_billed) OVER w AS total_billed_td
        FROM fact_w WINDOW w AS (PARTITION BY project_id, sov_line_id ORDER BY week_end
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "earned": f"""SELECT *,
        CASE WHEN productivity_factor > 0 THEN {d('estimated_labor_hours')} / {d('productivity_factor')}
            ELSE {d('estimated_labor_hours')} END AS budget_hours_adj,
        estimated_labor_cost * (pct_complete_td * 0.01) AS earned_labor_cost_td,
        (CASE WHEN productivity_factor > 0 THEN {d('estimated_labor_hours')} / {d('productivity_factor')}
            ELSE {d('estimated_labor_hours')} END) * ({d('pct_complete_td')} / {d('100')}) AS earned_labor_hours_td,
        estimated_material_cost * (pct_complete_td * 0.01) AS earned_material_cost_td
        FROM (SELECT f.*, coalesce(estimated_labor_hours, 0) AS estimated_labor_hours,
            coalesce(estimated_labor_cost, 0) AS estimated_labor_cost,
            coalesce(estimated_material_cost, 0) AS estimated_material_cost,
            coalesce(productivity_factor, 0) AS productivity_factor
            FROM fact_td f LEFT JOIN sov_budget b
            ON f.project_id = b.project_id AND f.sov_line_id = b.sov_line_id)""",
    "burns": f"""SELECT *,
        CASE WHEN pct_complete_td >= 5 AND estimated_labor_cost > 0
            THEN {over('labor_cost_td', 'earned_labor_cost_td')} END AS labor_burn_mult_cost,
        CASE WHEN pct_complete_td >= 5 AND estimated_labor_hours > 0
            THEN {over('labor_hours_td', 'earned_labor_hours_td')} END AS labor_burn_mult_hours,
        CASE WHEN pct_complete_td >= 5 AND estimated_material_cost > 0
            THEN {over('material_cost_td', 'earned_material_cost_td')} END AS material_burn_mult_cost,
        {over('ot_hours_td', 'st_hours_td + ot_hours_td')} AS ot_ratio_td,
        CASE WHEN total_billed_td > 0
            THEN {over('labor_cost_td + material_cost_td', 'total_billed_td')} END AS billing_lag_ratio
        FROM earned""",
    "closeout": f"""SELECT b.*,
        CASE WHEN estimated_labor_cost > 0 THEN {d('labor_cost_td')} / {d('estimated_labor_cost')} END AS labor_cost_ratio,
        CASE WHEN estimated_material_cost > 0 THEN {d('material_cost_td')} / {d('estimated_material_cost')} END AS mat_cost_ratio,
        early_burn
        FROM burns b JOIN (SELECT project_id, sov_line_id, max(week_end) AS week_end,
            arg_min(labor_burn_mult_cost, week_end) FILTER (WHERE labor_burn_mult_cost IS NOT NULL) AS early_burn
            FROM burns GROUP BY 1, 2) USING (project_id, sov_line_id, week_end)""",
    "scales": """SELECT project_id,
        median(CASE WHEN estimated_labor_cost > 0 AND labor_cost_td > 0 THEN labor_cost_ratio END) AS labor_scale,
        median(CASE WHEN estimated_material_cost > 0 AND material_cost_td > 0 THEN mat_cost_ratio END) AS mat_scale
        FROM closeout GROUP BY 1""",
    "variances": f"""SELECT *, var_labor_scaled + var_material_scaled AS var_total_scaled FROM (
        SELECT *, {d('labor_cost_td')} - {d('estimated_labor_cost')} * labor_scale AS var_labor_scaled,
        {d('material_cost_td')} - {d('estimated_material_cost')} * mat_scale AS var_material_scaled
        FROM closeout LEFT JOIN scales USING (project_id))""",
    "measured": """SELECT v.*, s.description AS sov_description, labor_cost_ratio / (labor_scale + 1e-9) AS labor_overrun_norm,
        early_burn / (labor_scale + 1e-9) AS labor_bm_cost_norm
        FROM variances v LEFT JOIN sov s ON v.sov_line_id = s.sov_line_id""",
    "leaking_work": "SELECT DISTINCT project_id, sov_description AS work FROM measured WHERE var_labor_scaled > 0 AND sov_description IS NOT NULL",
    "recurring": """SELECT sov_description, count(DISTINCT project_id) AS leaking_projects, count(*) AS leaking_lines
        FROM measured WHERE var_labor_scaled > 0 GROUP BY 1 HAVING count(DISTINCT project_id) >= 3""",
    "classified": f"""SELECT m.*, CASE
        WHEN estimated_labor_cost = 0 AND labor_cost_td > 0 THEN '{leaks.UNBUDGETED}'
        WHEN labor_bm_cost_norm > 1 AND var_labor_scaled > 0 THEN '{leaks.EARLY_DRIFT}'
        WHEN var_labor_scaled > 0 AND leaking_projects IS NOT NULL
            AND contains(lower(m.sov_description), 'terminal unit') THEN '{leaks.TERMINAL_UNITS}'
        WHEN var_labor_scaled > 0 AND leaking_projects IS NOT NULL
            AND (contains(lower(m.sov_description), 'controls') OR contains(lower(m.sov_description), 'commissioning'))
            THEN '{leaks.CONTROLS}'
        WHEN var_labor_scaled > 0 AND ot_ratio_td > 0.10 THEN '{leaks.OVERTIME}'
        WHEN var_labor_scaled > 0 THEN '{leaks.LATE}'
        WHEN labor_bm_cost_norm > 1 THEN '{leaks.RECOVERED}'
        ELSE '{leaks.ON_TRACK}' END AS archetype
        FROM measured m LEFT JOIN recurring USING (sov_description)""",
}

WEEKLY = ("labor_hours_w", "labor_cost_w", "st_hours_w", "ot_hours_w", "material_cost_w", "material_qty_w")
FACT = ("project_id", "sov_line_id", "week_end", *WEEKLY, "pct_complete", "total_billed", "scheduled_value",
        "description")
TD = ("labor_hours_td", "labor_cost_td", "material_cost_td", "st_hours_td", "ot_hours_td", "pct_complete_td",
      "total_billed_td")
EARNED = ("estimated_labor_hours", "estimated_labor_cost", "estimated_material_cost", "productivity_factor",
          "budget_hours_adj", "earned_labor_cost_td", "earned_labor_hours_td", "earned_material_cost_td")
BURNS = ("labor_burn_mult_cost", "labor_burn_mult_hours", "material_burn_mult_cost", "ot_ratio_td",
         "billing_lag_ratio")
CLOSEOUT = ("labor_cost_ratio", "mat_cost_ratio", "early_burn")
SCALED = ("labor_scale", "mat_scale", "var_labor_scaled", "var_material_scaled", "var_total_scaled")
AS_IS = ("project_id", "sov_line_id", "week_end", "description")
WHOLE = ("material_qty_w", "estimated_labor_hours")


def fact_columns(*groups) -> str:
    names = [n for g in groups for n in g]
    return ", ".join(
        n if n in AS_IS else f"{i(n)} AS {n}" if n in WHOLE else f"{r(d(n))} AS {n}" for n in names
    )


PROJECT_SUMS = ("labor_cost_td", "material_cost_td", "earned_labor_cost_td", "earned_material_cost_td",
                "total_billed_td", "ot_hours_td", "st_hours_td")
HELPERS["pw"] = "SELECT project_id, week_end, " + ", ".join(
    f"{total(c, 6)} AS {c}" for c in PROJECT_SUMS) + " FROM earned GROUP BY 1, 2"

PROJECT_WEEK = f"""SELECT project_id, week_end, {', '.join(f'{r(d(c))} AS {c}' for c in PROJECT_SUMS)},
    {r(d('labor_cost_td + material_cost_td'))} AS total_cost_td,
    {r(d('earned_labor_cost_td + earned_material_cost_td'))} AS earned_cost_td,
    {r(over('labor_cost_td + material_cost_td', 'earned_labor_cost_td + earned_material_cost_td'))} AS burn_mult_cost,
    {r(over('labor_cost_td', 'earned_labor_cost_td'))} AS labor_burn_mult_cost,
    {r(over('material_cost_td', 'earned_material_cost_td'))} AS material_burn_mult_cost,
    {r(over('ot_hours_td', 'ot_hours_td + st_hours_td'))} AS ot_ratio_td,
    CASE WHEN total_billed_td > 0 THEN {r(over('labor_cost_td + material_cost_td', 'total_billed_td'))} END
        AS billing_lag_ratio FROM pw"""

CHANGE_ORDER_COLUMNS = f"""project_id, co_number, date_submitted, reason_category, description, {d('amount')} AS amount,
    status, related_rfi, {i('labor_hours_impact')} AS labor_hours_impact,
    {i('schedule_impact_days')} AS schedule_impact_days, submitted_by, approved_by"""

SCOPE_ITEM = f"""scope_id, project_id, responsibility, co_status, {i('estimated_labor_hours')} AS estimated_labor_hours,
    {d('estimated_material_cost')} AS estimated_material_cost, {d(SCOPE)} AS estimated_total_cost"""

NOTE = """note_id, project_id, date, author, note_type, content, CAST(photos_attached AS BIGINT) AS photos_attached,
    weather, CAST(temp_high AS BIGINT) AS temp_high, CAST(temp_low AS BIGINT) AS temp_low, project_name"""

WORDS_OF = "regexp_split_to_array(lower(content), '[^\\p{L}0-9]+')"

BILL_COLUMNS = f"""project_id, {i('application_number')} AS application_number, period_end,
    {d('period_total')} AS period_total, {d('cumulative_billed')} AS cumulative_billed,
    {d('retention_held')} AS retention_held, {d('net_payment_due')} AS net_payment_due, status, payment_date,
    line_item_count"""

LAG = f"""{d('cost')} AS actual_cost, {d('billed')} AS billed, {d('cost - billed')} AS lag,
    {r(share('cost - billed', 'billed'))} AS lag_pct"""

DELTA = f"CASE WHEN value <> 0 AND billed <> 0 THEN {d('billed - cost')} / {d('billed')} - {d('value - bid')} / {d('value')} ELSE 0.0 END"
PROJECT_MARGINS = f"""SELECT project_id, project_name, {d('value')} AS contract_value, {d('bid')} AS bid_cost,
    {r(share('value - bid', 'value'))} AS bid_margin, {d('cost')} AS actual_cost, {d('billed')} AS billed,
    {r(share('billed - cost', 'billed'))} AS realized_margin, {r(DELTA)} AS margin_delta FROM p_all"""
HELPERS["margins"] = PROJECT_MARGINS


def checksum(c) -> str:
    kind = c.type.typeName()
    if kind == "string":
        number = f"CAST('0x' || substring(md5({c.name}), 1, 8) AS BIGINT)"
    elif kind == "date":
        number = f"date_diff('day', DATE '1970-01-01', {c.name})"
    else:
        whole = f"CAST({c.name} * 10000 AS BIGINT)" if kind == "decimal" else i(c.name)
        number = f"(({whole} % {CHECKSUM_PRIME} + {CHECKSUM_PRIME}) % {CHECKSUM_PRIME})"
    return i(f"coalesce(sum({number}), 0)")


def profile(table: str) -> str:
    """A row for each declared column of a table: its type, and what its values come to."""
    columns = ", ".join(
        f"""{{'column_name': '{c.name}', 'data_type': '{f"decimal scale {c.type.scale}" if c.type.typeName() == "decimal" else c.type.simpleString()}',
        'filled': count({c.name}), 'checksum': {checksum(c)}}}""" for c in TABLES[table].columns
    )
    return f"""SELECT '{table}' AS table_name, row_count, unnest(columns, recursive := true)
        FROM (SELECT count(*) AS row_count, [{columns}] AS columns FROM {table})"""


def primary_key(table: str) -> str:
    key = ", ".join(TABLES[table].key)
    return f"""SELECT '{table}' AS table_name, {i('coalesce(sum(n), 0)')} AS row_count,
        count(*) FILTER (WHERE n > 1) AS duplicate_keys, {i('coalesce(sum(n - 1), 0)')} AS duplicate_rows
        FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})"""


def foreign_key(ref) -> str:
    present = " AND ".join(f"{c} IS NOT NULL" for c in ref.columns)
    match = " AND ".join(f"p.{p} = k.{c}" for p, c in zip(ref.parent_columns, ref.columns))
    names = ", ".join(ref.columns)
    return f"""SELECT '{ref.child}' AS child_table, '{','.join(ref.columns)}' AS columns,
        '{ref.parent}' AS parent_table, count(*) AS orphan_keys, {i('coalesce(sum(n), 0)')} AS orphan_rows
        FROM (SELECT {names}, count(*) AS n FROM {ref.child} WHERE {present} GROUP BY {names}) k
        WHERE NOT EXISTS (SELECT 1 FROM {ref.parent} p WHERE {match})"""


def domain(table: str, column: str, allowed) -> str:
    values = ", ".join(f"'{v}'" for v in allowed)
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, {column} AS value, count(*) AS row_count
        FROM {table} WHERE {column} NOT IN ({values}) GROUP BY {column}"""


def not_null(table: str) -> list[str]:
    return [
        f"""SELECT '{table}' AS table_name, '{c.name}' AS column_name,
        count(*) FILTER (WHERE {c.name} IS NULL) AS null_rows FROM {table}"""
        for c in TABLES[table].columns if c.required
    ]


def length(table: str) -> list[str]:
    return [
        f"""SELECT '{table}' AS table_name, '{c.name}' AS column_name, {i(str(c.length))} AS declared_length,
        count(*) FILTER (WHERE length({c.name}) > {c.length}) AS rows_over,
        {i(f'max(length({c.name}))')} AS longest FROM {table}"""
        for c in TABLES[table].columns if c.length is not None
    ]


BILLING_WAIT = f"""SELECT project_id, count(*) AS entries, {d('sum(cost)')} AS cost,
    {r(f"CASE WHEN sum(cost) <> 0 THEN {d('sum(cost * lag)')} / {d('sum(cost)')} END")} AS lag_days
    FROM (SELECT l.project_id, {COST} AS cost, date_diff('day', l.date, b.period_end) AS lag
          FROM labor_logs l JOIN billing_line_items b ON b.project_id = l.project_id AND b.sov_line_id = l.sov_line_id
              AND b.period_end BETWEEN l.date AND l.date + 31) GROUP BY 1"""


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


BODIES: dict[str, str] = {
    "load_tables": union(profile(t) for t in TABLES),
    "normalise_nulls": f"""SELECT table_name, column_name, filled, row_count - filled AS missing
        FROM ({union(profile(t) for t in TABLES)})""",
    "normalise_bool": """SELECT project_id, rfi_number, cost_impact, schedule_impact FROM rfis""",
    "typed_schema": union(profile(t) for t in TABLES),
    "write_tables": union(profile(t) for t in TABLES),
    "write_facts": f"""SELECT 'fact_line_week' AS fact, {fact_columns(FACT, TD, EARNED)} FROM earned
        UNION ALL BY NAME SELECT 'fact_closeout' AS fact, {fact_columns(FACT, TD, EARNED, BURNS, CLOSEOUT)} FROM closeout
        UNION ALL BY NAME SELECT 'project_week' AS fact, * FROM ({PROJECT_WEEK})""",
    "read_fact_week": PROJECT_WEEK,
    "load_comparison": """SELECT *, 'changed' AS change FROM (SELECT * FROM load_gone INTERSECT SELECT * FROM load_come)
        UNION ALL SELECT *, 'deleted' FROM (SELECT * FROM load_gone EXCEPT SELECT * FROM load_come)
        UNION ALL SELECT *, 'inserted' FROM (SELECT * FROM load_come EXCEPT SELECT * FROM load_gone)""",
    "co_sov_lines": "SELECT project_id, co_number, sov_line_id FROM change_order_sov_lines",
    "co_impact_by_sov_line": f"""SELECT s.project_id, s.sov_line_id, s.description, count(*) AS co_count,
        {d('sum(amount)')} AS co_amount
        FROM change_order_sov_lines j
        JOIN change_orders c ON c.project_id = j.project_id AND c.co_number = j.co_number
        JOIN sov s ON s.sov_line_id = j.sov_line_id GROUP BY 1, 2, 3""",
    "labor_cost": f"SELECT log_id, {d(COST)} AS labor_cost FROM labor_logs",
    "labor_hours": f"SELECT log_id, {d(HOURS)} AS labor_hours FROM labor_logs",
    "bid_cost": f"SELECT sov_line_id, {d(BID)} AS bid_cost FROM sov_budget",
    "actual_cost": f"""SELECT project_id, sov_line_id, {d('coalesce(labor, 0) + coalesce(material, 0)')} AS actual_cost
        FROM l_labor FULL JOIN l_material USING (project_id, sov_line_id)""",
    "scope_cost": f"SELECT scope_id, {d(SCOPE)} AS scope_cost FROM scope_creep_candidates",
    "bid_margin": f"""SELECT s.sov_line_id, {r(share(f'scheduled_value - ({BID})', 'scheduled_value'))} AS bid_margin
        FROM sov s JOIN sov_budget b ON s.sov_line_id = b.sov_line_id""",
    "realized_margin": f"SELECT project_id, {r(share('billed - cost', 'billed'))} AS realized_margin FROM p_all",
    "margin_delta": "SELECT project_id, margin_delta FROM margins",
    "billing_lag": f"""SELECT project_id, {d('cost - billed')} AS lag, {r(share('cost - billed', 'billed'))} AS lag_pct
        FROM p_all""",
    "latest_billing": f"SELECT {BILL_COLUMNS} FROM last_bills",
    "latest_billing_one": f"""SELECT {BILL_COLUMNS} FROM billing_history WHERE project_id = '{PROJECT}'
        ORDER BY application_number DESC LIMIT 1""",
    "latest_billing_lines": f"""SELECT sov_line_id, project_id, {i('application_number')} AS application_number,
        description, {d('scheduled_value')} AS scheduled_value, {d('previous_billed')} AS previous_billed,
        {d('this_period')} AS this_period, {d('total_billed')} AS total_billed, {d('pct_complete')} AS pct_complete,
        {d('balance_to_finish')} AS balance_to_finish FROM last_lines""",
    "project_filter": f"""SELECT project_id, project_name, {d('original_contract_value')} AS original_contract_value,
        contract_date, substantial_completion_date, {d('retention_pct')} AS retention_pct, payment_terms, gc_name,
        architect, engineer_of_record FROM contracts WHERE project_id = '{PROJECT}'""",
    "field_notes_search": f"""SELECT {NOTE} FROM field_notes JOIN contracts USING (project_id)
        WHERE content ILIKE '%{SEARCH}%' AND note_type = '{NOTE_TYPE}'""",
    "field_notes_recent": f"""SELECT {NOTE} FROM field_notes JOIN contracts USING (project_id)
        ORDER BY date DESC, note_id LIMIT 100""",
    "field_notes_token_search": f"""SELECT {NOTE} FROM field_notes JOIN contracts USING (project_id) WHERE """
        + " AND ".join(f"list_contains({WORDS_OF}, '{w}')" for w in WORDS),
    "field_note_tokens": f"""SELECT DISTINCT note_id, token
        FROM (SELECT note_id, unnest({WORDS_OF}) AS token FROM field_notes) WHERE token <> ''""",
    "field_note_token_counts": f"""SELECT token, count(DISTINCT note_id) AS n_notes
        FROM (SELECT note_id, unnest({WORDS_OF}) AS token FROM field_notes) WHERE token <> '' GROUP BY 1""",
    "select_sql": f"""SELECT gc_name, {d('sum(total_cost)')} AS total_cost
        FROM material_deliveries JOIN contracts USING (project_id) GROUP BY 1""",
    "portfolio_overview": f"""SELECT {d('value')} AS total_contract_value, {d('bid')} AS total_bid_cost,
        {r(share('value - bid', 'value'))} AS bid_margin, {d('billed')} AS total_billed,
        {d('labor')} AS actual_labor_cost, {d('material')} AS actual_material_cost,
        {d('labor + material')} AS total_actual_cost,
        {r(share('billed - (labor + material)', 'billed'))} AS realized_margin, {d('at_risk')} AS at_risk_amount,
        project_count, pending_cos, {d('pending_amount')} AS pending_co_amount
        FROM (SELECT
            (SELECT {total('original_contract_value')} FROM contracts) AS value,
            (SELECT count(*) FROM contracts) AS project_count,
            (SELECT {total(BID)} FROM sov_budget) AS bid,
            (SELECT {total('cumulative_billed')} FROM last_bills) AS billed,
            (SELECT {total(COST, 6)} FROM labor_logs) AS labor,
            (SELECT {total('total_cost')} FROM material_deliveries) AS material,
            (SELECT coalesce(sum({SCOPE}), 0) FROM scope_creep_candidates WHERE co_status = 'not_submitted') AS at_risk,
            (SELECT count(*) FROM change_orders WHERE {PENDING}) AS pending_cos,
            (SELECT coalesce(sum(amount), 0) FROM change_orders WHERE {PENDING}) AS pending_amount)""",
    "at_risk_amount": f"""SELECT {d(f'coalesce(sum({SCOPE}), 0)')} AS at_risk_amount FROM scope_creep_candidates
        WHERE co_status = 'not_submitted'""",
    "pending_co_totals": f"""SELECT count(*) AS pending_cos, {d('coalesce(sum(amount), 0)')} AS pending_co_amount
        FROM change_orders WHERE {PENDING}""",
    "project_summaries": f"""SELECT * REPLACE ({r('bid_margin_pct')} AS bid_margin_pct,
        {r('realized_margin_pct')} AS realized_margin_pct, {r('pct_complete')} AS pct_complete) FROM summaries""",
    "project_pct_complete": f"""SELECT project_id, {r(f"avg({d('pct_complete')})")} AS pct_complete
        FROM last_lines GROUP BY 1""",
    "project_labor": f"SELECT project_id, {d('labor')} AS actual_labor_cost, {d('hours')} AS total_hours FROM p_labor",
    "project_material": f"SELECT project_id, {d('material')} AS actual_material_cost FROM p_material",
    "project_budget": f"""SELECT project_id, {d('b_labor')} AS budgeted_labor_cost,
        {d('b_material')} AS budgeted_material_cost, {d('b_equipment')} AS budgeted_equipment_cost,
        {d('b_sub')} AS budgeted_sub_cost, b_hours AS budgeted_labor_hours FROM p_budget""",
    "project_details": f"""SELECT c.project_id, project_name, {d('original_contract_value')} AS original_contract_value,
        contract_date, substantial_completion_date, {d('retention_pct')} AS retention_pct, payment_terms, gc_name,
        architect, engineer_of_record, {i('application_number')} AS application_number, period_end,
        {d('period_total')} AS period_total, {d('cumulative_billed')} AS cumulative_billed,
        {d('retention_held')} AS retention_held, {d('net_payment_due')} AS net_payment_due, status AS billing_status,
        {d('coalesce(labor, 0)')} AS labor_actual, {d('coalesce(b_labor, 0)')} AS labor_budgeted,
        {d('coalesce(hours, 0)')} AS hours_actual, {d('coalesce(b_hours, 0)')} AS hours_budgeted,
        {d('coalesce(material, 0)')} AS material_actual, {d('coalesce(b_material, 0)')} AS material_budgeted,
        {d('coalesce(b_equipment, 0)')} AS equipment_budget, {d('coalesce(b_sub, 0)')} AS subcontractor_budget
        FROM contracts c LEFT JOIN last_bills USING (project_id) LEFT JOIN p_labor USING (project_id)
        LEFT JOIN p_material USING (project_id) LEFT JOIN p_budget USING (project_id)""",
    "project_details_cos": f"""SELECT project_id, co_number, description, {d('amount')} AS amount, status,
        reason_category, date_submitted FROM change_orders""",
    "project_details_scope": f"""SELECT project_id, scope_id, description, responsibility, co_status,
        {i('estimated_labor_hours')} AS estimated_labor_hours, {d('estimated_material_cost')} AS estimated_material_cost
        FROM scope_creep_candidates""",
    "project_details_lines": f"""SELECT l.project_id, l.sov_line_id, s.description AS sov_description,
        {i('line_number')} AS line_number, {d('pct_complete')} AS pct_complete, {d('total_billed')} AS total_billed,
        {d('this_period')} AS this_period FROM last_lines l JOIN sov s ON s.sov_line_id = l.sov_line_id""",
    "margin_band": """SELECT project_id,
        CASE WHEN bid_margin_pct > 0.15 THEN 'green' WHEN bid_margin_pct > 0.10 THEN 'yellow' ELSE 'red' END AS bid_band,
        CASE WHEN realized_margin_pct > 0.15 THEN 'green' WHEN realized_margin_pct > 0.10 THEN 'yellow' ELSE 'red' END
        AS realized_band FROM summaries""",
    "margin_chart_data": f"""SELECT project_id,
        CASE WHEN length(project_name) > 15 THEN substring(project_name, 1, 15) || '...' ELSE project_name END AS name,
        {r('bid_margin_pct * 100', 1)} AS bid_margin, {r('realized_margin_pct * 100', 1)} AS realized_margin
        FROM summaries""",
    "margin_by_project": "SELECT * FROM margins",
    "margin_by_sov_line": f"""SELECT l.project_id, l.sov_line_id, {i('line_number')} AS line_number, description,
        {d('value')} AS scheduled_value, {d('bid')} AS bid_cost, {r(share('value - bid', 'value'))} AS bid_margin,
        {d('cost')} AS actual_cost, {d('labor')} AS actual_labor_cost, {d('material')} AS actual_material_cost,
        {d('billed')} AS billed, {r(share('billed - cost', 'billed'))} AS realized_margin, {d('bid - cost')} AS variance
        FROM l_all l JOIN (SELECT sov_line_id, {BID} AS bid FROM sov_budget) b ON b.sov_line_id = l.sov_line_id""",
    "margin_rank": f"""SELECT margin_rank, project_id, project_name, bid_margin, realized_margin, margin_delta
        FROM margins JOIN (SELECT project_id, rank() OVER (ORDER BY {DELTA}) AS margin_rank FROM p_all) USING (project_id)""",
    "labor_cost_by_sov_line": f"SELECT sov_line_id, {d(f'sum({COST})')} AS labor_cost FROM labor_logs GROUP BY 1",
    "billing_lag_by_project": f"SELECT project_id, project_name, {LAG} FROM p_all",
    "billing_lag_by_sov_line": f"""SELECT project_id, sov_line_id, {i('line_number')} AS line_number, description,
        {d('labor')} AS actual_labor_cost, {d('material')} AS actual_material_cost, {LAG} FROM l_all""",
    "billing_lag_total": f"""SELECT project_id, {d('sum(cost - billed)')} AS total_billing_lag FROM l_all GROUP BY 1""",
    "scope_items": f"""SELECT scope_id, project_id, project_name, description, responsibility, co_status,
        {i('estimated_labor_hours')} AS estimated_labor_hours, {d('estimated_material_cost')} AS estimated_material_cost,
        {d(SCOPE)} AS estimated_total_cost FROM scope_creep_candidates JOIN contracts USING (project_id)""",
    "scope_summary": f"""SELECT count(*) AS total_items, count(*) FILTER (WHERE {RECOVERABLE}) AS recoverable_count,
        {d(f'coalesce(sum({SCOPE}) FILTER (WHERE {RECOVERABLE}), 0)')} AS recoverable_total,
        count(*) FILTER (WHERE co_status = 'absorbed' OR responsibility = 'self_absorbed') AS absorbed_count,
        {d(f"coalesce(sum({SCOPE}) FILTER (WHERE co_status = 'absorbed' OR responsibility = 'self_absorbed'), 0)")}
            AS absorbed_total,
        count(*) FILTER (WHERE co_status IN ('pending', 'awaiting_approval')) AS pending_count,
        {d(f"coalesce(sum({SCOPE}) FILTER (WHERE co_status IN ('pending', 'awaiting_approval')), 0)")} AS pending_total
        FROM scope_creep_candidates JOIN contracts USING (project_id)""",
    "scope_unbilled_hours": f"""SELECT {i('sum(estimated_labor_hours)')} AS unbilled_hours
        FROM scope_creep_candidates WHERE co_status = 'not_submitted'""",
    "scope_recoverable": f"SELECT {SCOPE_ITEM} FROM scope_creep_candidates WHERE {RECOVERABLE}",
    "scope_absorbed": f"SELECT {SCOPE_ITEM} FROM scope_creep_candidates WHERE co_status = 'absorbed'",
    "scope_vs_change_orders": f"""SELECT project_id, coalesce(recoverable_count, 0) AS recoverable_count,
        {d('coalesce(recoverable_cost, 0)')} AS recoverable_cost, coalesce(pending_count, 0) AS pending_count,
        {d('coalesce(pending_amount, 0)')} AS pending_amount, coalesce(approved_count, 0) AS approved_count,
        {d('coalesce(approved_amount, 0)')} AS approved_amount FROM p_scope FULL JOIN p_co USING (project_id)""",
    "rework_labor": f"""SELECT project_id, count(*) AS entries, {d(f'sum({HOURS})')} AS hours, {d(f'sum({COST})')} AS cost
        FROM labor_logs WHERE log_id LIKE 'OVR-%' GROUP BY 1""",
    "rework_vs_scope": f"""SELECT project_id, {d('coalesce(rework, 0)')} AS rework_hours,
        {i('coalesce(estimated, 0)')} AS scope_hours,
        CASE WHEN coalesce(estimated, 0) <> 0 THEN {r(f"{d('coalesce(rework, 0)')} / {d('estimated')}")} END AS rework_ratio
        FROM (SELECT project_id, sum({HOURS}) AS rework FROM labor_logs WHERE log_id LIKE 'OVR-%' GROUP BY 1)
        FULL JOIN (SELECT project_id, sum(estimated_labor_hours) AS estimated FROM scope_creep_candidates GROUP BY 1)
        USING (project_id)""",
    "scope_description": """SELECT scope_id, CASE WHEN length(full_description) > 200
        THEN substring(full_description, 1, 200) || '...' ELSE full_description END AS description
        FROM scope_creep_candidates""",
    "labor_overruns": "SELECT * FROM overruns",
    "labor_overruns_flagged": "SELECT * FROM overruns WHERE flagged",
    "labor_overrun_total": f"""SELECT count(*) AS flagged_count,
        {d('coalesce(sum(actual_cost - budgeted_cost), 0)')} AS total_overrun_amount FROM labor_lines WHERE flagged""",
    "overrun_notes": """SELECT note_id, project_id, date, note_type, author, content FROM field_notes
        WHERE project_id IN (SELECT project_id FROM labor_lines WHERE flagged) AND ("""
        + " OR ".join(f"contains(lower(content), '{w}')" for w in CAUSES) + ")",
    "labor_rollup": f"""SELECT list_extract(['week', 'line', '', 'contract', '', '', '', 'portfolio'],
            CAST(grouping_id(project_id, sov_line_id, week_end) + 1 AS BIGINT)) AS level,
        project_id, sov_line_id, week_end, count(*) AS entries, {d('sum(hours)')} AS hours, {d('sum(cost)')} AS cost,
        {r(f"median({d('cost')})")} AS median_cost
        FROM (SELECT project_id, sov_line_id, {week_end('date')} AS week_end, {HOURS} AS hours, {COST} AS cost FROM labor_logs)
        GROUP BY ROLLUP (project_id, sov_line_id, week_end)""",
    "overrun_periods": "SELECT * FROM periods",
    "overrun_period_notes": """SELECT n.project_id, sov_line_id, over_from, over_to, overrun, note_id, date, note_type, author
        FROM field_notes n JOIN periods p ON p.project_id = n.project_id AND n.date BETWEEN over_from AND over_to
        WHERE (""" + " OR ".join(f"contains(lower(content), '{w}')" for w in CAUSES) + ")",
    "labor_week_billing": f"""SELECT w.project_id, w.sov_line_id, week_end, {d('labor_hours_w')} AS labor_hours_w,
        {d('labor_cost_w')} AS labor_cost_w, {d('cost_td')} AS labor_cost_td, {i('application_number')} AS application_number,
        period_end, date_diff('day', period_end, week_end) AS days_since, {d('pct_complete')} AS pct_complete,
        {d('total_billed')} AS total_billed, {d('cost_td - coalesce(total_billed, 0)')} AS unbilled
        FROM labor_w_td w ASOF LEFT JOIN billing_line_items b ON b.project_id = w.project_id
            AND b.sov_line_id = w.sov_line_id AND w.week_end >= b.period_end""",
    "change_orders_list": f"""SELECT co_number, project_id, project_name, description, {d('amount')} AS amount, status,
        reason_category AS reason, date_submitted FROM change_orders JOIN contracts USING (project_id)""",
    "co_status_summary": f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Approved') AS approved_count,
        {d("coalesce(sum(amount) FILTER (WHERE status = 'Approved'), 0)")} AS approved_amount,
        count(*) FILTER (WHERE {PENDING}) AS pending_count,
        {d(f'coalesce(sum(amount) FILTER (WHERE {PENDING}), 0)')} AS pending_amount,
        count(*) FILTER (WHERE status = 'Rejected') AS rejected_count,
        {d("coalesce(sum(amount) FILTER (WHERE status = 'Rejected'), 0)")} AS rejected_amount
        FROM change_orders JOIN contracts USING (project_id)""",
    "co_reason_summary": f"""SELECT coalesce(nullif(reason_category, ''), 'Unknown') AS reason, count(*) AS co_count,
        {d('sum(amount)')} AS total_amount FROM change_orders JOIN contracts USING (project_id) GROUP BY 1""",
    "co_summary_by_project": f"""SELECT c.project_id, project_name, coalesce(total_cos, 0) AS total_cos,
        coalesce(approved_count, 0) AS approved_count, coalesce(pending_count, 0) AS pending_count,
        coalesce(rejected_count, 0) AS rejected_count, {d('coalesce(approved_amount, 0)')} AS approved_amount,
        {d('coalesce(pending_amount, 0)')} AS pending_amount FROM contracts c LEFT JOIN p_co USING (project_id)""",
    "co_additions_credits": f"""SELECT project_id, count(*) AS co_count,
        {d('sum(CASE WHEN amount > 0 THEN amount ELSE 0 END)')} AS additions,
        {d('sum(CASE WHEN amount < 0 THEN amount ELSE 0 END)')} AS credits
        FROM change_orders WHERE status = 'Approved' GROUP BY 1""",
    "rfi_response_days": f"""SELECT assigned_to, {r('avg(date_diff(\'day\', date_submitted, date_responded))')} AS avg_days
        FROM rfis WHERE date_responded IS NOT NULL GROUP BY 1""",
    "rfi_cost_exposure": """SELECT project_id, priority, count(*) AS open_rfis, min(date_required) AS earliest_required
        FROM rfis WHERE cost_impact AND status <> 'Closed' GROUP BY 1, 2""",
    "co_with_rfi": f"""SELECT c.project_id, c.co_number, c.status, {d('c.amount')} AS amount, c.related_rfi,
        q.status AS rfi_status, q.priority AS rfi_priority, q.cost_impact AS rfi_cost_impact
        FROM change_orders c LEFT JOIN rfis q ON c.project_id = q.project_id AND c.related_rfi = q.rfi_number""",
    "alert_scope_creep": "SELECT * FROM alerts WHERE type = 'scope_creep'",
    "alert_labor_overrun": "SELECT * FROM alerts WHERE type = 'labor_overrun'",
    "alert_billing_lag": "SELECT * FROM alerts WHERE type = 'billing_lag'",
    "alert_pending_co": "SELECT * FROM alerts WHERE type = 'pending_co'",
    "risk_alerts": "SELECT * FROM alerts",
    "alert_message": "SELECT project_id, type, message FROM alerts",
    "week_end_sun": f"SELECT DISTINCT date, {week_end('date')} AS week_end FROM labor_logs",
    "closeout_cutoff": f"""SELECT project_id, coalesce(labor_rows, 0) AS labor_rows,
        coalesce(material_rows, 0) AS material_rows, {d('coalesce(labor, 0) + coalesce(material, 0)')} AS cost
        FROM (SELECT project_id, count(*) AS labor_rows, {total(COST, 6)} AS labor FROM labor_kept GROUP BY 1)
        FULL JOIN (SELECT project_id, count(*) AS material_rows, {total('total_cost')} AS material
                   FROM material_kept GROUP BY 1) USING (project_id)""",
    "billing_week": f"""SELECT project_id, sov_line_id, week_end, {d('pct_complete')} AS pct_complete,
        {d('total_billed')} AS total_billed, {d('scheduled_value')} AS scheduled_value, description FROM billing_w""",
    "labor_week": f"SELECT {fact_columns(FACT[:3], WEEKLY[:4])} FROM labor_w",
    "material_week": f"SELECT {fact_columns(FACT[:3], WEEKLY[4:])} FROM material_w",
    "week_spine": "SELECT project_id, sov_line_id, week_end FROM spine",
    "fact_line_week": f"SELECT {fact_columns(FACT)} FROM fact_w",
    "fact_line_week_td": f"SELECT {fact_columns(FACT, TD)} FROM fact_td",
    "fact_line_week_incremental": f"SELECT {fact_columns(FACT, TD)} FROM fact_td",
    "earned_value": f"SELECT {fact_columns(FACT, TD, EARNED)} FROM earned",
    "burn_signatures": f"SELECT {fact_columns(FACT, TD, EARNED, BURNS)} FROM burns",
    "rolling_burn": f"""SELECT project_id, sov_line_id, week_end, {d('labor_cost_w')} AS labor_cost_w, {d('budget')} AS budget,
        {d('earned_w')} AS earned_w, {d('cost_4w')} AS cost_4w, {d('earned_4w')} AS earned_4w, {d('excess')} AS excess, since,
        {r('burn_4w')} AS burn_4w FROM drift""",
    "burn_change_points": f"""SELECT project_id, sov_line_id, week_end AS signal_week, since AS change_week,
        date_diff('day', since, week_end) // 7 AS weeks_to_signal, {d('excess')} AS excess, {d('budget')} AS budget, {r('burn_4w')} AS burn_4w
        FROM drift WHERE excess > budget * 0.10
        QUALIFY row_number() OVER (PARTITION BY project_id, sov_line_id ORDER BY week_end) = 1""",
    "fact_closeout": f"SELECT {fact_columns(FACT, TD, EARNED, BURNS, CLOSEOUT)} FROM closeout",
    "project_scales": f"SELECT project_id, {r('labor_scale')} AS labor_scale, {r('mat_scale')} AS mat_scale FROM scales",
    "scaled_variance": f"SELECT {fact_columns(FACT, TD, EARNED, BURNS, CLOSEOUT, SCALED)} FROM variances",
    "project_week": PROJECT_WEEK,
    # As-of totals by a correlated lookup of every line's last week, unlike the Spark plan's running steps.
    "project_week_dense": "SELECT k.project_id, k.week_end, " + ", ".join(
        f"{r(d(f'sum(e.{c})'))} AS {c}" for c in PROJECT_SUMS) + """
        FROM (SELECT DISTINCT project_id, week_end FROM earned) k
        JOIN (SELECT *, lead(week_end) OVER (PARTITION BY project_id, sov_line_id ORDER BY week_end) AS next_week
              FROM earned) e
        ON e.project_id = k.project_id AND e.week_end <= k.week_end
            AND (e.next_week IS NULL OR e.next_week > k.week_end)
        GROUP BY 1, 2""",
    "project_closeout_summary": f"""SELECT project_id, {d('labor')} AS total_labor_cost,
        {d('material')} AS total_material_cost, {r(f"{d('labor')} - {d('b_labor')} * labor_scale")} AS total_labor_var_scaled,
        {r(f"({d('labor')} - {d('b_labor')} * labor_scale) + ({d('material')} - {d('b_material')} * mat_scale)")}
            AS total_var_scaled, num_sov_lines, {d('value')} AS scheduled_value, last_period_end,
        {r('labor_scale')} AS labor_scale, {r('mat_scale')} AS mat_scale
        FROM (SELECT project_id, labor_scale, mat_scale, {total('labor_cost_td', 6)} AS labor,
                  {total('material_cost_td')} AS material, {total('estimated_labor_cost')} AS b_labor,
                  {total('estimated_material_cost')} AS b_material, count(*) AS num_sov_lines
              FROM variances GROUP BY 1, 2, 3)
        LEFT JOIN (SELECT project_id, {total('scheduled_value')} AS value FROM sov GROUP BY 1) USING (project_id)
        LEFT JOIN last_period USING (project_id)""",
    "top_leaks": f"""SELECT project_id, sov_line_id, description, archetype, {r('var_labor_scaled')} AS var_labor_scaled,
        {r('labor_overrun_norm')} AS labor_overrun_norm, {r('ot_ratio_td')} AS ot_ratio_td,
        {r('labor_bm_cost_norm')} AS labor_bm_cost_norm FROM classified WHERE var_labor_scaled IS NOT NULL
        ORDER BY classified.var_labor_scaled DESC, sov_line_id LIMIT 15""",
    "leak_lines": f"""SELECT project_id, sov_line_id, description, archetype, {r('var_labor_scaled')} AS var_labor_scaled,
        {r('var_total_scaled')} AS var_total_scaled, {r('labor_overrun_norm')} AS labor_overrun_norm,
        {r('ot_ratio_td')} AS ot_ratio_td, {r('labor_bm_cost_norm')} AS labor_bm_cost_norm FROM classified""",
    "leak_archetypes": f"""SELECT archetype, count(*) AS lines, count(DISTINCT project_id) AS projects,
        {r(d('sum(CAST(var_labor_scaled AS DECIMAL(28,10)))'))} AS total_labor_var_scaled,
        {r(d('sum(CAST(var_total_scaled AS DECIMAL(28,10)))'))} AS total_var_scaled,
        {r('median(labor_bm_cost_norm)')} AS median_early_bm FROM classified GROUP BY 1""",
    "cross_project_pattern": """SELECT sov_description AS description, leaking_projects, leaking_lines FROM recurring""",
    "co_leaking_work": """SELECT a.work || ' + ' || b.work AS items, CAST(2 AS BIGINT) AS size, count(*) AS projects
        FROM leaking_work a JOIN leaking_work b ON b.project_id = a.project_id AND a.work < b.work GROUP BY 1 HAVING count(*) >= 3
        UNION ALL SELECT a.work || ' + ' || b.work || ' + ' || c.work, CAST(3 AS BIGINT), count(*)
        FROM leaking_work a JOIN leaking_work b ON b.project_id = a.project_id AND a.work < b.work
        JOIN leaking_work c ON c.project_id = a.project_id AND b.work < c.work GROUP BY 1 HAVING count(*) >= 3""",
    "stream_labor_week": f"SELECT {fact_columns(FACT[:3], WEEKLY[:4])} FROM labor_w_uncut",
    "stream_overrun_alerts": f"""SELECT project_id, {d('labor')} AS actual_labor_cost,
        {d('coalesce(b_labor, 0)')} AS budget_labor_cost, {d('labor - coalesce(b_labor, 0)')} AS overrun
        FROM p_labor LEFT JOIN p_budget USING (project_id) WHERE labor > coalesce(b_labor, 0) * 1.1""",
    "labor_billing_wait": BILLING_WAIT,
    "stream_labor_billing_wait": BILLING_WAIT,
    "stream_overrun_events": f"""SELECT project_id, 'opened' AS event, 'labor' AS reason,
        {d('coalesce(b_labor, 0)')} AS budget_labor_cost
        FROM p_labor LEFT JOIN p_budget USING (project_id) WHERE labor > coalesce(b_labor, 0) * 1.1""",
    "dq_primary_key": union(primary_key(t) for t in TABLES),
    "dq_foreign_key": union(foreign_key(ref) for ref in REFERENCES),
    "dq_domain": union(domain(t, c, v) for (t, c), v in DOMAINS.items()),
    "dq_not_null": union(part for t in TABLES for part in not_null(t)),
    "dq_length": union(part for t in TABLES for part in length(t)),
    "dq_sov_sum": f"""SELECT project_id, {d('original_contract_value')} AS contract_value,
        {d('coalesce(sov_total, 0)')} AS sov_total,
        {d('original_contract_value - coalesce(sov_total, 0)')} AS difference,
        original_contract_value = coalesce(sov_total, 0) AS ok
        FROM contracts LEFT JOIN (SELECT project_id, {total('scheduled_value')} AS sov_total FROM sov GROUP BY 1)
        USING (project_id)""",
    "dq_billing_cap": f"""SELECT project_id, count(*) AS lines,
        count(*) FILTER (WHERE total_billed > scheduled_value) AS lines_over,
        {d('max(total_billed - scheduled_value)')} AS largest_excess FROM billing_line_items GROUP BY 1""",
    "dq_billing_cumulative": """SELECT project_id, count(*) AS applications,
        count(*) FILTER (WHERE cumulative_billed <> running) AS mismatches
        FROM (SELECT *, sum(period_total) OVER (PARTITION BY project_id ORDER BY application_number) AS running
              FROM billing_history) GROUP BY 1""",
    "dq_cost_code": f"""SELECT l.project_id, count(*) AS labor_rows,
        count(*) FILTER (WHERE cost_code <> line_number) AS wrong_rows,
        count(*) FILTER (WHERE s.sov_line_id IS NULL) AS unknown_line_rows
        FROM labor_logs l LEFT JOIN sov s ON s.sov_line_id = l.sov_line_id GROUP BY 1""",
}

STATEMENTS = {name: with_tables(body, HELPERS) for name, body in BODIES.items()}
