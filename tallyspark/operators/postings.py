"""Project postings: write-offs (D47), journal pivot (D48), posting sources (D49.*),
posting detail (D50-D53l), project access (D34/D35), project dimension (D54-D57)
and the posting summary (D58).

Plan shape:

* Every source builds the same 55-column schema (``SOURCE_SCHEMA``), so the
  union is a plain ``unionByName`` of narrow frames; each builder prunes its
  own columns before the union.
* Journals are pivoted per transaction key with conditional aggregates (one
  partial + final aggregate, one shuffle on the key) before they meet the
  transaction lines.
* The cost-plus sources aggregate journal rows per (transaction, cost
  element) *before* joining the transaction line, so the line is joined once
  per group instead of once per journal row.
* The project access filter models its (open flag, role) pairs as a small
  table: open flags are unpivoted to (project, role) rows and matched with the
  viewer's per-role grants by equi joins -- one plan for 5 or 7 pairs instead
  of 5 or 7 copies of the predicate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import MONEY, concat_nn, round_to_scale
from .access import has_any_role, mask
from .calendar import trailing_months
from .dims import USER_FIELDS
from .joins import Lookup, held, join_lookups, join_within, left_join_split, pick, reads

# Journal categories.
CAT_BILLED, CAT_DEFERRED, CAT_REVENUE, CAT_UNBILLED, CAT_COST_TIME, CAT_WRITE_OFF = 1, 2, 3, 5, 6, 9
CAT_FUNDING_CAP, CAT_FEE_CAP, CAT_COST_EXPENSE = 10, 25, 18

# Fixed values: (open-access flag, role) pairs of the project access filters.
POSTING_OPEN_PAIRS = [("project_viewer_open", 14), ("project_manager_open", 3), ("resource_planner_open", 15),
                      ("resource_assigner_open", 18), ("resource_requestor_open", 17)]
PROJECT_DIM_OPEN_PAIRS = [("billing_viewer_open", 20), ("billing_manager_open", 19)] + POSTING_OPEN_PAIRS
POSTING_CONTROLLER_ROLES = (3, 14, 15, 18, 17)
PROJECT_DIM_CONTROLLER_ROLES = (3, 14, 19, 20, 15, 18, 17)
LEAD_ROLES = (12, 13)
ADMIN_ROLES = (1, 21)
COST_VIEW_ROLES = (1, 21, 10)
BILL_VIEW_ROLES = (1, 21, 16)

# Columns of a project that its dimension passes on, and the money only some roles see.
PROJECT_ATTRIBUTES = [
    "expense_assignment_flag", "future_charge", "item_assignment_flag", "time_assignment_flag", "assignment_flag", "hours_budget",
    "hours_est_tot", "hours_etc", "purpose", "completed_date", "project_color", "leave_balance", "enforce_wbs_dates", "account_number",
    "er_task_required", "item_task_required", "ts_task_required", "tito_required", "location_required", "task_level_assignment",
    "limit_bill_to_funded", "limit_rev_to_funded", "exp_sub_po_required", "ts_sub_po_required", "orig_start_date", "orig_end_date",
    "rev_start_date", "rev_end_date", "percent_complete", "pct_complete_rule", "probability_percent", "use_labor_category",
    "proj_require_time_comments", "self_assign_plans", "allow_self_plan", "advanced_costing_flag", *USER_FIELDS]
PROJECT_BILL_BUDGETS = ["exp_bill_budget", "labor_bill_budget", "exp_bill_est_tot", "labor_bill_est_tot", "exp_bill_etc", "labor_bill_etc"]
PROJECT_COST_BUDGETS = ["exp_cost_burden_budget", "exp_cost_budget", "labor_cost_burden_budget", "labor_cost_budget", "exp_cost_est_tot",
                        "labor_cost_est_tot", "exp_cost_etc", "labor_cost_etc"]
BILL_BUDGET_ROLES, COST_BUDGET_ROLES = (1, 21, 37, 39), (1, 21, 38, 40)
PROJECT_REVISED = ["total_cost", "total_fee", "funded_cost", "funded_fee"]  # with an original beside the current value
DOCUMENT_OPEN_FLAGS = ["project_po_viewer_open", "project_pr_viewer_open", "project_document_viewer_open"]
BILL_RATE_SOURCES = {"P": "P - Person Bill Rate", "L": "L - Labor Category Bill Rate"}
COST_RATE_SOURCES = {"P": "P - Person Cost Rate", "L": "L - Labor Category Cost Rate"}
CONTROLLER_COLUMNS = ["first_name", "last_name", "middle_initial", "username", "email"]

# Cost element type decode.
COST_ELEMENT_TYPES = {"O": "ODC", "L": "Labor", "P": "Indirect", "Fee": "Fee"}

SOURCE_SCHEMA = [
    ("transaction_data_key", "bigint"), ("timesheet_key", "bigint"), ("expense_report_key", "bigint"),
    ("fin_document_key", "bigint"), ("project_key", "bigint"), ("person_key", "bigint"), ("task_key", "bigint"),
    ("labor_category_key", "bigint"), ("cust_invoice_key", "bigint"), ("vendor_invoicing_key", "bigint"),
    ("document_number", "string"), ("trans_project_type_key", "bigint"), ("trans_date", "date"),
    ("ts_adjustment_number", "int"), ("ts_adjustment_status", "string"), ("transaction_type", "string"),
    ("source_doc_type", "string"), ("source_doc_status", "string"), ("source_doc_number", "string"),
    ("er_completion_date", "date"), ("ts_or_er_posted_date", "date"), ("comments_description", "string"),
    ("expense_type", "string"), ("post_date_cost", "date"), ("post_date_unbilled", "date"),
    ("post_date_billed", "date"), ("post_date_deferred_rev", "date"), ("post_date_recognized_rev", "date"),
    ("quantity_cost", "decimal(18,6)"), ("quantity_net_billable", "decimal(19,6)"),
    ("quantity_writeoff", "decimal(38,6)"), ("item_code", "string"), ("item_name", "string"),
    ("item_uom", "string"), ("bill_amount", "decimal(18,2)"), ("cost_amount", "decimal(18,2)"),
    ("billable_amount", "decimal(18,2)"), ("postings_cost", "decimal(38,2)"), ("postings_unbilled", "decimal(38,2)"),
    ("postings_billed", "decimal(38,2)"), ("postings_deferred", "decimal(38,2)"),
    ("postings_revenue", "decimal(38,2)"), ("postings_writeoff", "decimal(38,2)"), ("bill_rate", "decimal(18,6)"),
    ("cost_rate", "decimal(19,6)"), ("cost_element", "string"), ("cost_element_desc", "string"),
    ("cost_element_type", "string"), ("cost_structure", "string"), ("posted_indicator", "string"),
    ("account_key", "bigint"), ("ic_cost_amount", "decimal(18,2)"), ("ic_cost_currency", "bigint"),
    ("cost_currency", "bigint"), ("bill_currency", "bigint"),
]
SOURCE_COLUMNS = [c for c, _ in SOURCE_SCHEMA]


def conform(cols: dict) -> list[Column]:
    """Project a source onto the shared schema: given expressions, typed NULLs elsewhere."""
    return [(cols[c] if c in cols else F.lit(None)).cast(t).alias(c) for c, t in SOURCE_SCHEMA]


# --------------------------------------------------------------------------- D47
def writeoffs(invcd: DataFrame, invoice: DataFrame, key: str) -> DataFrame:
    """Write-off quantity per line: completed invoices only, voided invoices count negative."""
    inv = invoice.filter(F.col("completed_date").isNotNull()).select("invoice_key", "voided_invoice_key")
    q = F.col("writeoff_quantity")
    return (invcd.join(inv, "invoice_key")
            .groupBy(key).agg(F.sum(F.when(F.col("voided_invoice_key").isNotNull(), -q).otherwise(q))
                              .alias("write_off_quantity")))


# --------------------------------------------------------------------------- D48
def _cat_date(c: int) -> Column:
    return F.max(F.when(F.col("category") == c, F.col("journal_trans_date")))


def _cat_sum(c: int) -> Column:
    return F.sum(F.when(F.col("category") == c, F.col("amount")))


def journal_pivot(journal: DataFrame, keys, revenue_cat: int = CAT_REVENUE, cost_cat: int | None = CAT_COST_TIME,
                  extra=()) -> DataFrame:
    """Category pivot per key: latest date and summed amount per posting category."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    aggs = [
        _cat_date(CAT_UNBILLED).alias("post_date_unbilled"), _cat_date(CAT_BILLED).alias("post_date_billed"),
        _cat_date(CAT_DEFERRED).alias("post_date_deferred_rev"),
        _cat_date(revenue_cat).alias("post_date_recognized_rev"),
        _cat_sum(CAT_UNBILLED).alias("unbilled"), _cat_sum(CAT_BILLED).alias("billed"),
        _cat_sum(CAT_DEFERRED).alias("deferred"), _cat_sum(revenue_cat).alias("revenue"),
        _cat_sum(CAT_WRITE_OFF).alias("write_off"),
        (_cat_sum(cost_cat) if cost_cat is not None else F.lit(None).cast(MONEY)).alias("posted_cost"),
        (F.max("account_key") if "account_key" in journal.columns else F.lit(None).cast("bigint")).alias("account_key"),
        *extra,
    ]
    return journal.groupBy(*keys).agg(*aggs)


# ------------------------------------------------------------------ D49.1
def _posted_indicator(*keys) -> Column:
    return F.when(F.coalesce(*[F.col(k) for k in keys]).isNull(), "N").otherwise("Y")


def _vendor_docs(lg) -> DataFrame:
    return (lg.vendor_invoice.select(F.col("fin_document_key").alias("vendor_invoice_key"))
            .join(lg.fin_document.select(F.col("fin_document_key").alias("vendor_invoice_key"),
                                         "document_number"), "vendor_invoice_key")
            .select("vendor_invoice_key", F.col("vendor_invoice_key").alias("vendor_invoicing_key"),
                    "document_number"))


def _cost_structure(lg, key_col: str, table: str, key: str) -> DataFrame:
    link = lg.table(table).select(F.col(key).alias(key_col), "cost_struct_key", "cost_element_key")
    near = held(link)  # a few keys for all lines: a shuffle by them would be wide and uneven
    return near(link.join(lg.cost_struct, "cost_struct_key", "left")
            .join(lg.cost_element.select("cost_element_key", F.col("code").alias("ce_code"),
                                         F.col("description").alias("ce_desc"),
                                         F.col("cost_element_type").alias("ce_type")), "cost_element_key", "left")
            .select(key_col, "cost_structure", "ce_code", "ce_desc", "ce_type"))


def source_timesheet_labor(lg) -> DataFrame:
    """D49.1: timesheet labor lines with their journal pivot and write-offs."""
    ptd = lg.person_time_data
    pt = lg.person_time.select("person_time_key", "person_key", "status", "adjustment_status")
    ph = lg.post_history.select(F.col("post_history_key").alias("cost_post_history_key"),
                                F.col("journal_trans_date").alias("_ph_date"))
    jv = journal_pivot(lg.journal_time, "time_data_key")
    wv = writeoffs(lg.invcd_time, lg.invoice, "time_data_key")
    # the small lookups come last: their texts so move with no row
    df = (ptd.join(pt, "person_time_key")
          .transform(lambda d: left_join_split(d, _vendor_docs(lg), "vendor_invoice_key"))
          .join(jv, "time_data_key", "left").join(wv, "time_data_key", "left").join(ph, "cost_post_history_key", "left")
          .join(_cost_structure(lg, "cost_struct_labor_key", "cost_struct_labor", "cost_struct_labor_key"),
                "cost_struct_labor_key", "left"))
    q, wo = F.col("quantity"), F.col("write_off_quantity")
    return df.select(*conform({
        "transaction_data_key": F.col("time_data_key"), "timesheet_key": F.col("person_time_key"),
        "project_key": F.col("project_key"), "person_key": F.col("person_key"), "task_key": F.col("task_key"),
        "labor_category_key": F.col("labor_category_key"), "cust_invoice_key": F.col("invoice_key"),
        "vendor_invoicing_key": F.col("vendor_invoicing_key"), "document_number": F.col("document_number"),
        "trans_project_type_key": F.col("project_type_key"), "trans_date": F.col("work_date"),
        "ts_adjustment_number": F.col("adjusted_number"), "ts_adjustment_status": F.col("adjustment_status"),
        "transaction_type": F.lit("Labor"), "source_doc_type": F.lit("TS"), "source_doc_status": F.col("status"),
        "source_doc_number": F.col("person_time_key").cast("string"), "ts_or_er_posted_date": F.col("post_date"),
        "comments_description": F.col("comments"), "post_date_cost": F.col("_ph_date"),
        "post_date_unbilled": F.col("post_date_unbilled"), "post_date_billed": F.col("post_date_billed"),
        "post_date_deferred_rev": F.col("post_date_deferred_rev"),
        "post_date_recognized_rev": F.col("post_date_recognized_rev"), "quantity_cost": q,
        "quantity_net_billable": F.coalesce(q - wo, q), "quantity_writeoff": wo,
        "bill_amount": F.col("bill_amount"), "cost_amount": F.col("cost_amount"),
        "billable_amount": F.col("bill_amount"), "postings_cost": F.col("posted_cost"),
        "postings_unbilled": F.col("unbilled"), "postings_billed": F.col("billed"),
        "postings_deferred": F.col("deferred"), "postings_revenue": F.col("revenue"),
        "postings_writeoff": F.col("write_off"), "bill_rate": F.col("eff_bill_rate"),
        "cost_rate": F.coalesce(F.col("eff_cost_rate") - F.col("additional_pay"), F.col("eff_cost_rate")),
        "cost_element": F.col("ce_code"), "cost_element_desc": F.col("ce_desc"),
        "cost_element_type": F.col("ce_type"), "cost_structure": F.col("cost_structure"),
        "posted_indicator": _posted_indicator("post_history_key", "cost_post_history_key"),
        "account_key": F.col("account_key"), "ic_cost_amount": F.col("ic_cost_amount"),
        "ic_cost_currency": F.col("ic_cost_currency"), "cost_currency": F.col("cost_currency"),
        "bill_currency": F.col("bill_currency"),
    }))


# ------------------------------------------------------------------ D49.2
def source_timesheet_cost_plus(lg) -> DataFrame:
    """D49.2: cost-plus postings of timesheet lines, grouped per (line, cost element or fee method).

    The reference looks the structure up in ``cost_struct_odc`` with the
    line's *labor* structure key; that join is kept as written.
    """
    cppd = lg.cost_plus_post_detail.filter(F.col("time_data_key").isNotNull()).select(
        "cost_plus_post_detail_key", "time_data_key", "cost_element_key", "fee_method_key",
        F.col("invoice_key").alias("_cp_invoice"), F.col("post_history_key").alias("_cp_ph"))
    ph = lg.post_history.select(F.col("post_history_key").alias("_cp_ph"), F.col("journal_trans_date").alias("_ph_date"))
    fm = lg.fee_method.select("fee_method_key", "fee_method")
    ce = lg.cost_element.select("cost_element_key", F.col("code").alias("ce_code"),
                                F.col("description").alias("ce_desc"), F.col("cost_element_type").alias("ce_type"))
    j = (lg.journal_cost_plus_detail.join(cppd, "cost_plus_post_detail_key")
         .join(ph, "_cp_ph", "left").join(fm, "fee_method_key", "left").join(ce, "cost_element_key", "left"))
    elem = F.coalesce(F.col("ce_code"), F.col("fee_method"))
    groups = journal_pivot(
        j.withColumn("_elem", elem), ["time_data_key", "_elem"], cost_cat=None,
        extra=(F.max("_ph_date").alias("_ph_date"), F.max("_cp_invoice").alias("_cp_invoice"),
               F.max(F.coalesce(F.col("ce_desc"), F.col("fee_method"))).alias("_elem_desc"),
               F.max(F.when(F.col("ce_type").isNull(), F.lit("Fee")).otherwise(F.col("ce_type"))).alias("_elem_type")))
    ptd = lg.person_time_data.select("time_data_key", "person_time_key", "project_key", "task_key",
                                     "labor_category_key", "project_type_key", "work_date", "adjusted_number",
                                     "post_date", "comments", "quantity", "bill_amount", "cost_amount",
                                     "post_history_key", "cost_post_history_key", "ic_cost_amount",
                                     "ic_cost_currency", "cost_currency", "bill_currency", "cost_struct_labor_key")
    pt = lg.person_time.select("person_time_key", "person_key", "status", "adjustment_status")
    cso = _cost_structure(lg, "cost_struct_labor_key", "cost_struct_odc", "cost_struct_odc_key") \
        .select("cost_struct_labor_key", "cost_structure")
    wv = writeoffs(lg.invcd_time, lg.invoice, "time_data_key")
    df = (groups.join(ptd, "time_data_key").join(wv, "time_data_key", "left").join(pt, "person_time_key")
          .join(cso, "cost_struct_labor_key", "left"))
    q, wo = F.col("quantity"), F.col("write_off_quantity")
    return df.select(*conform({
        "transaction_data_key": F.col("time_data_key"), "timesheet_key": F.col("person_time_key"),
        "project_key": F.col("project_key"), "person_key": F.col("person_key"), "task_key": F.col("task_key"),
        "labor_category_key": F.col("labor_category_key"), "cust_invoice_key": F.col("_cp_invoice"),
        "trans_project_type_key": F.col("project_type_key"), "trans_date": F.col("work_date"),
        "ts_adjustment_number": F.col("adjusted_number"), "ts_adjustment_status": F.col("adjustment_status"),
        "transaction_type": F.lit("Labor"), "source_doc_type": F.lit("TS"), "source_doc_status": F.col("status"),
        "source_doc_number": F.col("person_time_key").cast("string"), "ts_or_er_posted_date": F.col("post_date"),
        "comments_description": F.col("comments"), "post_date_cost": F.col("_ph_date"),
        "post_date_unbilled": F.col("post_date_unbilled"), "post_date_billed": F.col("post_date_billed"),
        "post_date_deferred_rev": F.col("post_date_deferred_rev"),
        "post_date_recognized_rev": F.col("post_date_recognized_rev"), "quantity_cost": q,
        "quantity_net_billable": F.coalesce(q - wo, q), "bill_amount": F.col("bill_amount"),
        "cost_amount": F.col("cost_amount"), "postings_unbilled": F.col("unbilled"),
        "postings_billed": F.col("billed"), "postings_deferred": F.col("deferred"),
        "postings_revenue": F.col("revenue"), "postings_writeoff": F.col("write_off"),
        "cost_element": F.col("_elem"), "cost_element_desc": F.col("_elem_desc"),
        "cost_element_type": F.col("_elem_type"), "cost_structure": F.col("cost_structure"),
        "posted_indicator": _posted_indicator("post_history_key", "cost_post_history_key"),
        "account_key": F.col("account_key"), "ic_cost_amount": F.col("ic_cost_amount"),
        "ic_cost_currency": F.col("ic_cost_currency"), "cost_currency": F.col("cost_currency"),
        "bill_currency": F.col("bill_currency"),
    }))


# ------------------------------------------------------------- D49.11 - D49.15
def _project_charge(lg, table: str, key: str, journal: str, ttype: str, revenue_cat: int, trans_date: Column,
                    comments, amount: str, posted: Column, with_task: bool, write_off: bool,
                    element=None, structure: bool = False, joins=()) -> DataFrame:
    """Shared shape of the project-level charge sources: charge row, project, optional task,
    extra inner lookups, and its own journal pivot (revenue category varies by source)."""
    jv = journal_pivot(lg.table(journal), key, revenue_cat=revenue_cat, cost_cat=None,
                       extra=(F.max("journal_trans_date").alias("_last_journal_date"),))
    p = lg.project.select("project_key", F.col("project_type_key").alias("_p_ptype"), F.col("cost_struct_key"),
                          F.col("project_currency"), F.col("project_billing_currency"),
                          F.col("completed_date").alias("_p_completed"), F.col("rev_end_date").alias("_p_rev_end"))
    df = lg.table(table).join(p, "project_key")
    if with_task:
        t = lg.task.select("task_key", F.col("project_type_key").alias("_t_ptype"),
                           F.col("completed").alias("_t_completed"), F.col("rev_end_date").alias("_t_rev_end"))
        df = df.join(t, "task_key", "left")
    for frame, on in joins:
        df = df.join(frame, on)
    if structure:
        df = df.join(lg.cost_struct, "cost_struct_key", "left")
    df = df.join(jv, key, "left")
    ptype = F.coalesce(F.col("_t_ptype"), F.col("_p_ptype")) if with_task else F.col("_p_ptype")
    cols = {
        "transaction_data_key": F.col(key), "project_key": F.col("project_key"),
        "task_key": F.col("task_key") if with_task else None, "cust_invoice_key": F.col("invoice_key"),
        "trans_project_type_key": ptype, "trans_date": trans_date, "transaction_type": F.lit(ttype),
        "comments_description": comments,
        "post_date_unbilled": F.col("post_date_unbilled"), "post_date_billed": F.col("post_date_billed"),
        "post_date_deferred_rev": F.col("post_date_deferred_rev"),
        "post_date_recognized_rev": F.col("post_date_recognized_rev"),
        "bill_amount": F.col(amount), "billable_amount": F.col(amount),
        "postings_unbilled": F.col("unbilled"), "postings_billed": F.col("billed"),
        "postings_deferred": F.col("deferred"), "postings_revenue": F.col("revenue"),
        "postings_writeoff": F.col("write_off") if write_off else None,
        "cost_element": element, "cost_element_desc": element, "cost_element_type": element,
        "cost_structure": F.col("cost_structure") if structure else None,
        "posted_indicator": posted, "account_key": F.col("account_key"),
        "cost_currency": F.col("project_currency"), "bill_currency": F.col("project_billing_currency"),
    }
    return df.select(*conform({k: v for k, v in cols.items() if v is not None}))


def source_fixed_price(lg) -> DataFrame:
    """D49.11: fixed-price items; dated by the WBS end (task, then project) when flagged."""
    wbs_end = F.coalesce(F.col("_t_completed"), F.col("_t_rev_end"), F.col("_p_completed"), F.col("_p_rev_end"))
    return _project_charge(
        lg, "fixed_price", "fixed_price_key", "journal_fixed_price", "Fixed Price Items", CAT_REVENUE,
        F.when(F.col("use_wbs_end_date") == "Y", wbs_end).otherwise(F.col("bill_date")), F.col("description"),
        "amount", _posted_indicator("post_history_key", "billable_post_history_key"), True, True)


def source_prebilled_labor(lg) -> DataFrame:
    """D49.12: pre-billed labor items (no task, no write-off)."""
    return _project_charge(
        lg, "prebilled_labor", "prebilled_labor_key", "journal_prebilled_labor", "Pre-billed Labor Items",
        CAT_REVENUE, F.col("bill_date"), F.col("description"), "amount", _posted_indicator("post_history_key"),
        False, False)


def source_funding_cap(lg) -> DataFrame:
    """D49.13: funding-cap adjustments, revenue in category 10, dated by their posting."""
    ph = lg.post_history.select("post_history_key", F.col("journal_trans_date").alias("_ph_date"))
    label = F.lit("Funding Cap Adjustment")
    return _project_charge(
        lg, "funding_cap_adjustment", "funding_cap_adjustment_key", "journal_funding_cap_adjustment",
        "Funding Cap Adjustments", CAT_FUNDING_CAP, F.col("_ph_date"), None, "bill_amount",
        _posted_indicator("post_history_key"), True, True, element=label, structure=True,
        joins=[(ph, "post_history_key")])


def source_fee_cap(lg) -> DataFrame:
    """D49.14: fee-cap adjustments, revenue in category 25, labelled by fee method."""
    ph = lg.post_history.select("post_history_key", F.col("journal_trans_date").alias("_ph_date"))
    fm = lg.fee_method.select("fee_method_key", "fee_method")
    return _project_charge(
        lg, "fee_cap_adjustment", "fee_cap_adjustment_key", "journal_fee_cap_adjustment", "Fee Cap Adjustments",
        CAT_FEE_CAP, F.col("_ph_date"), F.col("fee_method"), "bill_amount", _posted_indicator("post_history_key"),
        False, True, element=F.col("fee_method"), joins=[(ph, "post_history_key"), (fm, "fee_method_key")])


def source_onetime_charge(lg) -> DataFrame:
    """D49.15: one-time charges, dated by their invoice; posted when any journal row exists."""
    inv = lg.invoice.select("invoice_key", F.col("invoice_date").alias("_inv_date"))
    return _project_charge(
        lg, "onetime_charge", "onetime_charge_key", "journal_onetime_charge", "Additional Items", CAT_REVENUE,
        F.col("_inv_date"), F.col("description"), "amount",
        F.when(F.col("_last_journal_date").isNotNull(), "Y").otherwise("N"), True, False,
        joins=[(inv, "invoice_key")])


# ------------------------------------------------------------- D49.3 - D49.10
EXCLUDED_EXPENSE_TYPES = ("ADVANCE", "CASH-RETURN")  # fixed values: never posted as expense/item lines

# Financial document types (the document decode differs from the GL one).
DOCUMENT_TYPES = {0: "VI", 1: "VP", 3: "CP", 4: "D", 5: "JE", 6: "BR", 7: "CI", 8: "LC", 9: "EC", 10: "FY",
                  11: "AL", 12: "CMT"}


def document_type(col) -> Column:
    """D11, document form: 12 is CMT, 2/13/14 are unknown, unknown gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in DOCUMENT_TYPES.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr


def _struct(lg, table: str, key_col: str) -> DataFrame:
    key = "cost_struct_labor_key" if table == "cost_struct_labor" else "cost_struct_odc_key"
    return _cost_structure(lg, key_col, table, key)


def _expense_types(lg, exclude: bool) -> DataFrame:
    et = lg.expense_type
    if exclude:
        et = et.filter(~F.col("expense_type").isin(*EXCLUDED_EXPENSE_TYPES))
    return et.select("expense_type_key", F.col("expense_type").alias("_et_code"), F.col("expense_type_name").alias("_et_name"))


def _documents(lg) -> DataFrame:
    """Documents with their vendor invoice, if they are one: all that a line takes from its document, by one key."""
    return (lg.fin_document.select("fin_document_key", F.col("document_type").alias("_doc_type"),
                                   F.col("status").alias("_doc_status"), F.col("document_number").alias("_doc_number"),
                                   F.col("post_date").alias("_doc_post_date"), F.col("currency").alias("_doc_currency"))
            .join(_vendor_docs(lg).withColumnRenamed("vendor_invoice_key", "fin_document_key"), "fin_document_key", "left"))


def line_documents(lg) -> DataFrame:
    """The document of each line of one, by both keys: narrow rows that the sources meet by the line's key.

    A vendor invoice has its document's key, and most often its number:
    ``_vendor`` and ``_same`` say so, ``_other_number`` is a number that differs.
    """
    lines = lg.fin_document_detail.select("fin_document_detail_key", "fin_document_key").distinct()
    same = F.col("document_number").eqNullSafe(F.col("_doc_number"))
    docs = _documents(lg).select(
        "fin_document_key", "_doc_type", "_doc_status", "_doc_number", "_doc_post_date", "_doc_currency",
        F.col("vendor_invoicing_key").isNotNull().alias("_vendor"), same.alias("_same"),
        F.when(~same, F.col("document_number")).alias("_other_number"))
    return lines.join(docs, "fin_document_key")


def _met_documents(lg, df: DataFrame) -> DataFrame:
    """Lines with their documents; where these are stored by line (``line_documents``) no line is moved."""
    known = getattr(lg, "line_documents", None)
    if known is None:
        return df.join(_documents(lg), "fin_document_key")
    return join_within(df, known, "fin_document_detail_key", "fin_document_key").withColumns({
        "vendor_invoicing_key": F.when(F.col("_vendor"), F.col("fin_document_key")),
        "document_number": F.when(F.col("_same"), F.col("_doc_number")).otherwise(F.col("_other_number"))})


def _line_frame(lg, family: str, cost_plus: bool) -> DataFrame:
    """Transaction lines of one family, keyed by ``_line_key``, with their per-line lookups.

    Lines of documents lack their document: all joins by the line's key come
    first, as its tables are stored by that key, and ``_with_documents`` last.
    """
    if family == "expense":
        eda, ed = lg.expense_data_allocation, lg.expense_data
        er = lg.expense_report.select("expense_report_key", "owner_key", F.col("currency").alias("_er_currency"),
                                      "date_completed", F.col("post_date").alias("_er_post"), F.col("status").alias("_er_status"))
        df = (eda.join(ed.select("expense_data_key", "expense_report_key", "expense_type_key",
                                 F.col("comments").alias("_ed_comments"), "expense_date", "summary"), "expense_data_key")
              .join(_expense_types(lg, exclude=not cost_plus), "expense_type_key").join(er, "expense_report_key"))
        if not cost_plus:
            df = left_join_split(df, _vendor_docs(lg), "vendor_invoice_key")
        return df.withColumn("_line_key", F.col("expense_data_allocation_key"))
    fdd = lg.fin_document_detail.select("fin_document_detail_key", "fin_document_key", "person_key", "account_key",
                                        "transaction_date", F.col("description").alias("_fdd_desc"))
    proj, det = lg.table(f"fin_document_det_proj_{family[4:]}"), lg.table(f"fin_document_detail_{family[4:]}")
    skey = _struct_key(family)
    det = det.select("fin_document_detail_key", skey, F.col("invoice_key").alias("_det_invoice"),
                     F.col("post_history_key").alias("_det_ph"), F.col("amount").alias("_det_amount"),
                     F.col("bill_amount").alias("_det_bill"), F.col("bill_currency").alias("_det_bill_ccy"),
                     *(["bill_rate"] if family == "fin_labor" else []),
                     *(["expense_type_key"] if family == "fin_item" else []))
    df = fdd.join(proj, "fin_document_detail_key")
    if family == "fin_item":
        df = df.join(lg.fin_doc_det_item, "fin_document_detail_key")
    # the cost-plus variants reach the line through its detail row, so it is an inner join there
    df = df.join(det, "fin_document_detail_key", "inner" if cost_plus else "left")
    if family in ("fin_labor", "fin_item"):
        # both read the labor write-off table (the item CTE reads it too, as in the reference)
        df = df.join(writeoffs(lg.invcd_document_labor, lg.invoice, "fin_document_detail_key"),
                     "fin_document_detail_key", "left")
    return df.withColumn("_line_key", F.col("fin_document_detail_key"))


def _struct_key(family: str) -> str:
    return "cost_struct_labor_key" if family == "fin_labor" else "cost_struct_odc_key"


def _with_documents(lg, df: DataFrame, family: str) -> DataFrame:
    """``df`` with the document of each line and then the small lookups, whose texts so move with no row.

    Lines of expense reports have no document.
    """
    if family != "expense":
        df = _met_documents(lg, df)
    if family == "fin_item":
        df = (df.join(lg.item.select("item_key", F.col("code").alias("_item_code"), F.col("name").alias("_item_name")), "item_key")
              .join(lg.unit_of_measure.select("uom_key", F.col("name").alias("_uom")), "uom_key"))
    if family in ("fin_expense", "fin_item"):
        df = df.join(_expense_types(lg, exclude=family == "fin_item"), "expense_type_key")
    key = _struct_key(family)
    return df.join(_struct(lg, key.removesuffix("_key"), key), key, "left")


def _family_columns(family: str, cost_plus: bool) -> dict:
    if family == "expense":
        cols = {
            "transaction_data_key": F.col("expense_data_allocation_key"), "expense_report_key": F.col("expense_report_key"),
            "project_key": F.col("project_key"), "person_key": F.col("owner_key"), "task_key": F.col("task_key"),
            "trans_project_type_key": F.col("project_type_key"), "trans_date": F.col("expense_date"),
            "transaction_type": F.lit("Expense Reports"), "source_doc_type": F.lit("ER"),
            "source_doc_status": F.col("_er_status"), "source_doc_number": F.col("expense_report_key").cast("string"),
            "er_completion_date": F.col("date_completed"), "ts_or_er_posted_date": F.col("_er_post"),
            "comments_description": concat_nn(concat_nn("_ed_comments", F.lit(" ")), "summary"),
            "expense_type": F.coalesce(F.col("_et_name"), F.col("_et_code")),
            "bill_amount": F.col("bill_amount"), "cost_amount": F.col("amount"),
            "posted_indicator": _posted_indicator("post_history_key", "cost_post_history_key"),
            "ic_cost_amount": F.col("ic_cost_amount"), "ic_cost_currency": F.col("ic_cost_currency"),
            "cost_currency": F.col("_er_currency"), "bill_currency": F.col("bill_currency"),
        }
        if not cost_plus:
            cols.update({"cust_invoice_key": F.col("invoice_key"), "vendor_invoicing_key": F.col("vendor_invoicing_key"),
                         "document_number": F.col("document_number"), "billable_amount": F.col("bill_amount")})
        return cols
    ttype = {"fin_labor": "Financial Labor", "fin_expense": "Financial Expenses", "fin_item": "Financial Items"}[family]
    cols = {
        "transaction_data_key": F.col("fin_document_detail_key"), "fin_document_key": F.col("fin_document_key"),
        "project_key": F.col("project_key"), "person_key": F.col("person_key"), "task_key": F.col("task_key"),
        "vendor_invoicing_key": F.col("vendor_invoicing_key"), "document_number": F.col("document_number"),
        "trans_project_type_key": F.col("project_type_key"), "trans_date": F.col("transaction_date"),
        "transaction_type": F.lit(ttype), "source_doc_type": document_type("_doc_type"),
        "source_doc_status": F.col("_doc_status"), "source_doc_number": F.col("_doc_number"),
        "comments_description": F.col("_fdd_desc"), "post_date_cost": F.col("_doc_post_date"),
        "bill_amount": F.col("_det_bill"), "cost_amount": F.col("_det_amount"),
        "posted_indicator": F.when(F.col("_det_ph").isNull(), "N").otherwise("Y"),
        "account_key": F.col("account_key"), "cost_currency": F.col("_doc_currency"),
        "bill_currency": F.col("_det_bill_ccy"),
    }
    if family == "fin_labor":
        cols["labor_category_key"] = F.col("labor_category_key")
        cols["quantity_cost"] = F.col("hours")
        q = F.col("hours")
    elif family == "fin_item":
        cols.update({"quantity_cost": F.col("quantity"), "item_code": F.col("_item_code"),
                     "item_name": F.col("_item_name"), "item_uom": F.col("_uom"), "expense_type": F.col("_et_name")})
        q = F.col("quantity")
    else:
        cols["expense_type"] = F.col("_et_name")
        q = None
    if q is not None:
        cols["quantity_net_billable"] = F.coalesce(q - F.col("write_off_quantity"), q)
    if not cost_plus:
        cols.update({"cust_invoice_key": F.col("_det_invoice"), "billable_amount": F.col("_det_bill"),
                     "postings_cost": F.col("_det_amount")})
        if q is not None:
            cols["quantity_writeoff"] = F.col("write_off_quantity")
        if family == "fin_labor":
            cols.update({"bill_rate": F.col("bill_rate"), "cost_rate": F.col("cost_rate")})
    return cols


def _with_pivot(cols: dict, elem: bool = False) -> dict:
    cols = dict(cols)
    cols.update({
        "post_date_unbilled": F.col("post_date_unbilled"), "post_date_billed": F.col("post_date_billed"),
        "post_date_deferred_rev": F.col("post_date_deferred_rev"),
        "post_date_recognized_rev": F.col("post_date_recognized_rev"),
        "postings_unbilled": F.col("unbilled"), "postings_billed": F.col("billed"),
        "postings_deferred": F.col("deferred"), "postings_revenue": F.col("revenue"),
        "postings_writeoff": F.col("write_off"),
    })
    return cols


def _direct_source(lg, family: str, journal: str, cost_cat=None) -> DataFrame:
    df = _line_frame(lg, family, cost_plus=False)
    key = "expense_data_allocation_key" if family == "expense" else "fin_document_detail_key"
    jv = (journal_pivot(lg.table(journal), key, cost_cat=cost_cat)
          .withColumnRenamed("account_key", "_jv_account").withColumnRenamed("posted_cost", "_jv_posted_cost"))
    df = _with_documents(lg, df.join(jv, key, "left"), family)
    cols = _with_pivot(_family_columns(family, False))
    cols.update({"cost_element": F.col("ce_code"), "cost_element_desc": F.col("ce_desc"),
                 "cost_element_type": F.col("ce_type"), "cost_structure": F.col("cost_structure")})
    if family == "expense":
        ph = lg.post_history.select(F.col("post_history_key").alias("cost_post_history_key"),
                                    F.col("journal_trans_date").alias("_ph_date"))
        df = df.join(ph, "cost_post_history_key", "left")
        cols.update({"post_date_cost": F.col("_ph_date"), "postings_cost": F.col("_jv_posted_cost"),
                     "account_key": F.col("_jv_account")})
    return df.select(*conform(cols))


def _cost_plus_source(lg, family: str, link: str) -> DataFrame:
    """Cost-plus variant: journal rows aggregated per (line, cost element or fee method) first."""
    # the link is NULL for postings of the other families
    cppd = lg.cost_plus_post_detail.filter(F.col(link).isNotNull()).select(
        "cost_plus_post_detail_key", F.col(link).alias("_line_key"), "cost_element_key", "fee_method_key",
        F.col("invoice_key").alias("_cp_invoice"), F.col("post_history_key").alias("_cp_ph"))
    ph = lg.post_history.select(F.col("post_history_key").alias("_cp_ph"), F.col("journal_trans_date").alias("_ph_date"))
    ce = lg.cost_element.select("cost_element_key", F.col("code").alias("_ce_code"),
                                F.col("description").alias("_ce_desc"), F.col("cost_element_type").alias("_ce_type"))
    j = (lg.journal_cost_plus_detail.join(cppd, "cost_plus_post_detail_key").join(ph, "_cp_ph", "left")
         .join(lg.fee_method, "fee_method_key", "left").join(ce, "cost_element_key", "left")
         .withColumn("_elem", F.coalesce(F.col("_ce_code"), F.col("fee_method"))))
    groups = journal_pivot(j, ["_line_key", "_elem"], cost_cat=None, extra=(
        F.max("_ph_date").alias("_cp_ph_date"), F.max("_cp_invoice").alias("_cp_invoice_key"),
        F.max(F.coalesce(F.col("_ce_desc"), F.col("fee_method"))).alias("_elem_desc"),
        F.max(F.when(F.col("_ce_type").isNull(), F.lit("Fee")).otherwise(F.col("_ce_type"))).alias("_elem_type"),
    )).withColumnRenamed("account_key", "_jv_account")
    df = _with_documents(lg, groups.join(_line_frame(lg, family, cost_plus=True), "_line_key"), family)
    cols = _with_pivot(_family_columns(family, True))
    cols.update({"cust_invoice_key": F.col("_cp_invoice_key"), "cost_element": F.col("_elem"),
                 "cost_element_desc": F.col("_elem_desc"), "cost_element_type": F.col("_elem_type"),
                 "cost_structure": F.col("cost_structure")})
    if family == "expense":
        cols.update({"post_date_cost": F.col("_cp_ph_date"), "account_key": F.col("_jv_account")})
    else:
        cols["account_key"] = F.col("account_key")
    return df.select(*conform(cols))


def source_expense(lg):
    """D49.3: expense-report allocations (ADVANCE and CASH-RETURN excluded)."""
    return _direct_source(lg, "expense", "journal_expense", cost_cat=CAT_COST_EXPENSE)


def source_expense_cost_plus(lg):
    """D49.4: cost-plus postings of expense allocations (no type exclusion, as in the reference)."""
    return _cost_plus_source(lg, "expense", "expense_data_allocation_key")


def source_fin_labor(lg):
    """D49.5: labor lines of financial documents."""
    return _direct_source(lg, "fin_labor", "journal_document_labor")


def source_fin_labor_cost_plus(lg):
    """D49.6: cost-plus postings of financial labor lines."""
    return _cost_plus_source(lg, "fin_labor", "fin_document_det_labor_key")


def source_fin_expense(lg):
    """D49.7: expense lines of financial documents."""
    return _direct_source(lg, "fin_expense", "journal_document_expense")


def source_fin_expense_cost_plus(lg):
    """D49.8: cost-plus postings of financial expense lines."""
    return _cost_plus_source(lg, "fin_expense", "fin_document_det_expense_key")


def source_fin_item(lg):
    """D49.9: item lines of financial documents (excluded expense types dropped)."""
    return _direct_source(lg, "fin_item", "journal_document_item")


def source_fin_item_cost_plus(lg):
    """D49.10: cost-plus postings of financial item lines."""
    return _cost_plus_source(lg, "fin_item", "fin_document_det_item_key")


SOURCES = {
    "expense": source_expense,
    "expense_cost_plus": source_expense_cost_plus,
    "fin_labor": source_fin_labor,
    "fin_labor_cost_plus": source_fin_labor_cost_plus,
    "fin_expense": source_fin_expense,
    "fin_expense_cost_plus": source_fin_expense_cost_plus,
    "fin_item": source_fin_item,
    "fin_item_cost_plus": source_fin_item_cost_plus,
    "timesheet_labor": source_timesheet_labor,
    "timesheet_cost_plus": source_timesheet_cost_plus,
    "fixed_price": source_fixed_price,
    "prebilled_labor": source_prebilled_labor,
    "funding_cap": source_funding_cap,
    "fee_cap": source_fee_cap,
    "onetime_charge": source_onetime_charge,
}


def posting_sources(lg, names=None) -> DataFrame:
    names = list(names or SOURCES)
    return reduce(DataFrame.unionByName, [SOURCES[n](lg) for n in names])


# ------------------------------------------------------------------ D34 / D35
def project_access(lg, viewer: int, controller_roles, open_pairs):
    """Grants for the project filters: (flag column, allowed projects, allowed (project, org, owner))."""
    pc = lg.project_controller
    alt = lg.alternate.filter(F.col("alternate_key") == F.lit(viewer)).select("person_key", "role_key")
    own_ctrl = pc.filter((F.col("person_key") == F.lit(viewer))
                         & F.col("role_key").isin(*controller_roles, *LEAD_ROLES)).select("project_key")
    alt_ctrl = (pc.filter((F.col("primary_ind") == "Y") & F.col("role_key").isin(*controller_roles, *LEAD_ROLES))
                .join(alt, ["person_key", "role_key"]).select("project_key"))
    projects = own_ctrl.unionByName(alt_ctrl)
    # (open flag, role) pairs as rows: unpivot the flags of each project
    pra = lg.project_open_access_view
    stack = ", ".join(f"{role}, {flag}" for flag, role in open_pairs)
    opened = (pra.selectExpr("project_key", f"stack({len(open_pairs)}, {stack}) as (role_key, is_open)")
              .filter(F.col("is_open") == "Y").select("project_key", "role_key"))
    oap = lg.org_access_person.filter((F.col("person_key") == F.lit(viewer))
                                      & F.col("role_key").isin(*[r for _, r in open_pairs]))
    glob = (oap.filter(F.col("global_access") == "Y")
            .groupBy("role_key").agg(F.max(F.when(F.col("access_type") == 1, True)).alias("g1"),
                                      F.max(F.when(F.col("access_type") == 4, True)).alias("g4")))
    hier = lg.org_access_hierarchy.join(oap, "org_access_person_key")
    h1 = hier.filter(F.col("access_type") == 1).select("role_key", F.col("customer_key").alias("org_key"),
                                                       F.lit(True).alias("h1")).distinct()
    h4 = hier.filter(F.col("access_type") == 4).select("role_key", F.col("customer_key").alias("owner_key"),
                                                       F.lit(True).alias("h4")).distinct()
    return has_any_role(lg.member, viewer, ADMIN_ROLES), projects, opened, glob, h1, h4


def allowed_projects(lg, viewer: int, controller_roles=POSTING_CONTROLLER_ROLES, open_pairs=POSTING_OPEN_PAIRS,
                     owner_must_exist: bool = True) -> tuple[Column, DataFrame]:
    """(viewer flag, keys of the projects the viewer may see) for D34/D35.

    Every grant condition depends only on the project (its key, its org and
    its owning org), so it is evaluated on the project table -- a dimension --
    and the fact is then filtered by project key alone.  With
    ``owner_must_exist`` the owning org counts only if it exists as an org
    (the posting detail reaches it through a left join); the project
    dimension tests the raw key.
    """
    flag, projects, opened, glob, h1, h4 = project_access(lg, viewer, controller_roles, open_pairs)
    p = lg.project.select("project_key", F.col("customer_key").alias("org_key"),
                          F.col("owning_customer_key").alias("owner_key"))
    if owner_must_exist:
        orgs = lg.customer.select(F.col("customer_key").alias("owner_key"), F.lit(True).alias("_own_exists"))
        p = p.join(orgs, "owner_key", "left").select(
            "project_key", "org_key", F.when(F.col("_own_exists"), F.col("owner_key")).alias("owner_key"))
    by_pair = (p.join(opened, "project_key").join(glob, "role_key", "left")
               .join(h1, ["role_key", "org_key"], "left").join(h4, ["role_key", "owner_key"], "left")
               .filter((F.col("g1") | F.col("h1")) & (F.col("g4") | F.col("h4")))
               .select("project_key"))
    return flag, by_pair.unionByName(projects)


def filter_project_access(lg, df: DataFrame, project_col: str, viewer: int,
                          controller_roles=POSTING_CONTROLLER_ROLES, open_pairs=POSTING_OPEN_PAIRS,
                          owner_must_exist: bool = True) -> DataFrame:
    """Admin, controller (or alternate of a primary controller), or for some
    (open flag, role) pair: project open AND (global or project-org grant) AND (global or owner grant).

    The allowed keys are joined, not listed in a subquery: a subquery in a
    filter would be pushed into every branch of a union below and planned once
    for each.
    """
    flag, allowed = allowed_projects(lg, viewer, controller_roles, open_pairs, owner_must_exist)
    # at most one row for each project, which Spark cannot tell from the joins that give it
    near = held(lg.project.select("project_key").unionByName(lg.project_controller.select("project_key")))
    keys = near(allowed.select(F.col("project_key").alias("_allowed")).distinct())
    return df.join(keys, F.col(project_col) == F.col("_allowed"), "left").filter(flag | F.col("_allowed").isNotNull()).drop("_allowed")


# ------------------------------------------------------------------ D50 - D53l
def _decode(col: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(default)


def _shown_if_posted(amount: str, date: str) -> Column:
    a = F.col(amount)
    return F.when(a.isNotNull() & (a != 0), F.col(date))


def posting_detail(lg, viewer: int, as_of: str, months_back: int = 60, sources=None, store=None) -> DataFrame:
    """Posting lines of all sources with lookups, masking and the project filter.

    ``store`` (a ``PostingStore``) reads the sources where they are staged.
    Every grant depends on the project alone, so the filter stands before the
    lookups: rows a viewer may not see meet no join.
    """
    x = store.read(sources, as_of, months_back) if store is not None else posting_sources(lg, sources)
    x = x.filter(trailing_months("trans_date", as_of, months_back))
    x = filter_project_access(lg, x, "project_key", viewer)
    per = held(lg.person)(lg.person.select("person_key", F.col("last_name").alias("person_last_name"),
                                           F.col("first_name").alias("person_first_name"),
                                           F.col("middle_initial").alias("person_middle_initial"),
                                           F.col("username").alias("person_username")))
    # the project's own lookups are joined to it, not to the postings; one without an organization drops its postings
    p = lg.project.select("project_key", F.col("project_code"), F.col("title").alias("project_title"),
                          F.col("customer_key").alias("_porg"), F.col("owning_customer_key").alias("_own"),
                          F.col("billing_type_key").alias("_p_bt"))
    pttr = lg.project_type.select(F.col("project_type_key").alias("trans_project_type_key"),
                                  F.col("billable").alias("billable_indicator"),
                                  F.col("project_type").alias("transaction_project_type"))
    t = lg.task.select("task_key", "task_number", "task_name", F.col("billing_type_key").alias("_t_bt"))
    org = lg.customer.select("customer_key", "customer_code", "customer_name", "legal_entity_key")
    porg = org.select(F.col("customer_key").alias("_porg"), F.col("customer_key").alias("project_organization_key"),
                      F.col("customer_code").alias("project_org_code"), F.col("customer_name").alias("project_org_name"))
    own = org.select(F.col("customer_key").alias("_own"), F.col("customer_key").alias("project_owning_org_key"),
                     F.col("customer_code").alias("project_owning_org_code"),
                     F.col("customer_name").alias("project_owning_org_name"), F.col("legal_entity_key").alias("_cle"))
    cle = org.select(F.col("customer_key").alias("_cle"), F.col("customer_code").alias("legal_entity_code"),
                     F.col("customer_name").alias("legal_entity_name"))
    lc = lg.labor_category.select("labor_category_key", "labor_category", F.col("description").alias("_lc_desc"))
    bt = lg.billing_type
    btp = bt.select(F.col("billing_type_key").alias("_p_bt"), F.col("code").alias("_btp"))
    btt = bt.select(F.col("billing_type_key").alias("_t_bt"), F.col("code").alias("_btt"))
    inv = lg.invoice.select(F.col("invoice_key").alias("cust_invoice_key"),
                            F.col("invoice_number").alias("customer_invoicing_number"))
    ccy = lg.currency_code

    def cur(key, prefix):
        return F.broadcast(ccy.select(F.col("currency_code_key").alias(key), F.col("iso_currency_code").alias(f"{prefix}_code"),
                                      F.col("decimals").alias(f"{prefix}_dec")))
    near = held(lg.project_controller)
    ctrl = lg.project_controller.select("project_key", "person_key", "primary_ind").distinct()
    prim = near(ctrl.filter(F.col("primary_ind") == "Y").select("project_key", "person_key", F.lit(True).alias("_prim")))
    alti = near(ctrl.filter(F.col("primary_ind") == "N").select("project_key", "person_key", F.lit(True).alias("_alt")))
    p = held(lg.project)(p.join(porg, "_porg").join(own, "_own", "left").join(cle, "_cle", "left").join(btp, "_p_bt", "left"))
    df = (x.join(per, "person_key", "left").join(p, "project_key").join(pttr, "trans_project_type_key")
          .join(t, "task_key", "left").join(lc, "labor_category_key", "left").join(btt, "_t_bt", "left")
          .join(inv, "cust_invoice_key", "left").join(cur("bill_currency", "bcc"), "bill_currency", "left")
          .join(cur("cost_currency", "ccc"), "cost_currency", "left")
          .join(cur("ic_cost_currency", "icc"), "ic_cost_currency", "left")
          .join(prim, ["project_key", "person_key"], "left").join(alti, ["project_key", "person_key"], "left"))
    see_cost = has_any_role(lg.member, viewer, COST_VIEW_ROLES)
    see_bill = has_any_role(lg.member, viewer, BILL_VIEW_ROLES)
    billable = F.col("billable_indicator") == "Y"
    ttype = F.col("transaction_type")
    return df.select(
        "transaction_data_key", "timesheet_key", "expense_report_key", F.col("fin_document_key").alias("financial_document_key"),
        "project_key", "person_key", "task_key", "project_organization_key", "project_owning_org_key",
        "cust_invoice_key", "vendor_invoicing_key",
        F.when(F.col("_prim").isNotNull(), "Primary").when(F.col("_alt").isNotNull(), "Alternate").otherwise("")
        .alias("primary_or_alternate_project"),
        "project_org_code", "project_org_name", "project_owning_org_code", "project_owning_org_name",
        "legal_entity_code", "legal_entity_name", "project_code", "project_title", "billable_indicator",
        "person_last_name", "person_first_name", "person_middle_initial", "person_username",
        "transaction_project_type",
        F.when(billable, F.when(F.col("_t_bt").isNotNull(), F.col("_btt")).otherwise(F.col("_btp")))
        .otherwise("NB").alias("transaction_billing_type"),
        F.col("trans_date").alias("transaction_date"), "ts_adjustment_number", "ts_adjustment_status",
        "transaction_type", "source_doc_type", "source_doc_status", "source_doc_number", "er_completion_date",
        "ts_or_er_posted_date", F.col("comments_description").alias("comments"), "task_number", "task_name",
        "labor_category",
        F.when(ttype == "Fee Cap Adjustments", F.col("cost_element"))
        .when(ttype.isin("Fixed Price Items", "Additional Items"), F.col("comments_description"))
        .otherwise(F.col("_lc_desc")).alias("labor_category_description"),
        "expense_type", "customer_invoicing_number", F.col("document_number").alias("vendor_invoicing_number"),
        _shown_if_posted("postings_cost", "post_date_cost").alias("post_date_cost"),
        _shown_if_posted("postings_unbilled", "post_date_unbilled").alias("post_date_unbilled"),
        _shown_if_posted("postings_billed", "post_date_billed").alias("post_date_billed"),
        _shown_if_posted("postings_deferred", "post_date_deferred_rev").alias("post_date_deferred_revenue"),
        _shown_if_posted("postings_revenue", "post_date_recognized_rev").alias("post_date_recognized_revenue"),
        "quantity_cost", F.when(billable, F.col("quantity_net_billable")).alias("quantity_net_billable"),
        "quantity_writeoff", "item_code", "item_name", "item_uom",
        F.when(see_cost, round_to_scale(F.col("cost_amount"), F.col("ccc_dec"))).alias("cost_amount"),
        F.when(see_bill, round_to_scale(F.col("bill_amount"), F.col("bcc_dec"))).alias("bill_amount"),
        F.when(see_bill & billable, round_to_scale(F.col("billable_amount"), F.col("bcc_dec"))).alias("billable_amount"),
        "postings_writeoff", "postings_unbilled", "postings_billed", "postings_deferred", "postings_revenue",
        "postings_cost", F.when(see_bill, F.col("bill_rate")).alias("bill_rate"),
        F.when(see_cost, F.col("cost_rate")).alias("cost_rate"), "cost_element",
        F.col("cost_element_desc").alias("cost_element_description"),
        _decode(F.col("cost_element_type"), COST_ELEMENT_TYPES, "").alias("cost_element_type"),
        "cost_structure", "posted_indicator", F.col("account_key").alias("gl_account_key"),
        F.col("ccc_code").alias("transaction_currency_code"), F.col("bcc_code").alias("billing_currency_code"),
        F.col("ic_cost_amount").alias("intercompany_cost_amount"), F.col("icc_code").alias("intercompany_currency_code"),
    )


# ------------------------------------------------------------------ D54 - D57
def intercompany_list(lg) -> DataFrame:
    """Per project, the intercompany partner names joined with ', ' (sorted, for a defined order)."""
    names = lg.project_intercompany.join(
        lg.customer.select(F.col("customer_key").alias("ic_org"), "customer_name"), "ic_org", "left")
    agg = names.groupBy("project_key").agg(F.sort_array(F.collect_list("customer_name")).alias("_n"))
    return agg.select("project_key", F.when(F.size("_n") > 0, F.array_join("_n", ", ")).alias("pi_list"))


def first_fee_method(lg) -> DataFrame:
    """The project's fee rows of its alphabetically first fee method (ties: lowest key)."""
    from pyspark.sql import Window
    pf = lg.project_fee
    ranked = pf.join(lg.fee_method, "fee_method_key").withColumn(
        "_rn", F.row_number().over(Window.partitionBy("project_key").orderBy("fee_method", "fee_method_key")))
    first = ranked.filter(F.col("_rn") == 1).select("project_key", "fee_method_key")
    return pf.join(first, ["project_key", "fee_method_key"])


def _project_lookups(lg) -> list[Lookup]:
    """Everything that can be looked up for a project (D54-D57), in join order."""
    org = lambda key, **names: lambda: lg.customer.select(
        F.col("customer_key").alias(key), *[F.col(c).alias(n) for n, c in names.items()])
    pc = lg.project_controller.filter(F.col("primary_ind") == "Y")

    def controllers(role, who):
        return Lookup(lambda: pc.filter(F.col("role_key") == role).select("project_key", F.col("person_key").alias(f"_{who}")),
                      ("project_key",), (f"_{who}",), many=True)

    def person(who):
        return Lookup(lambda: lg.person.select(F.col("person_key").alias(f"_{who}"),
                                               *[F.col(c).alias(f"{who}_{c}") for c in CONTROLLER_COLUMNS]),
                      (f"_{who}",), tuple(f"{who}_{c}" for c in CONTROLLER_COLUMNS))

    def fees():
        return (first_fee_method(lg).join(lg.fee_method, "fee_method_key", "left")
                .select("project_key", "fee_method", "fee_factor", "fee_factor_type", "fixed_fee_amount"))

    org_names = {"project_org_code": "customer_code", "project_org_name": "customer_name", "customer_type_key": "customer_type_key"}
    own_names = {"owning_org_code": "customer_code", "owning_org_name": "customer_name", "_col": "legal_entity_key", "_ooc": "currency_code_key"}
    le_names = {"owning_le_code": "customer_code", "owning_le_name": "customer_name"}
    roles = (("project_manager", 3), ("project_lead", 12), ("project_viewer", 14))
    return [
        Lookup(org("customer_key", **org_names), ("customer_key",), tuple(org_names), how="inner"),
        Lookup(org("owning_customer_key", **own_names), ("owning_customer_key",), tuple(own_names)),
        Lookup(lambda: lg.customer_type, ("customer_type_key",), ("customer_type",)),
        Lookup(lambda: lg.billing_type.select("billing_type_key", F.col("code").alias("proj_billing_type_code")),
               ("billing_type_key",), ("proj_billing_type_code",)),
        Lookup(lambda: lg.cost_struct, ("cost_struct_key",), ("cost_structure",)),
        Lookup(lambda: lg.location, ("location_key",), ("location_name",)),
        Lookup(lambda: lg.pay_code, ("pay_code_key",), ("pay_code",)),
        Lookup(lambda: lg.project_open_access_view, ("project_key",), (*[f for f, _ in PROJECT_DIM_OPEN_PAIRS], *DOCUMENT_OPEN_FLAGS)),
        *[controllers(role, who) for who, role in roles],
        *[person(who) for who, _ in roles],
        Lookup(lambda: lg.posting_group, ("posting_group_key",), ("posting_group_name",)),
        Lookup(lambda: lg.project_status, ("project_status_key",), ("status",), how="inner"),
        Lookup(lambda: lg.project_type.select("project_type_key", "project_type"), ("project_type_key",), ("project_type",), how="inner"),
        Lookup(org("_col", **le_names), ("_col",), tuple(le_names)),
        Lookup(lambda: lg.contract.select("contract_key", "contract_code", "contract_title", "prime_contract_key"),
               ("contract_key",), ("contract_code", "contract_title", "prime_contract_key")),
        Lookup(lambda: lg.contract.select(F.col("contract_key").alias("prime_contract_key"), F.col("contract_code").alias("_m_code"),
                                          F.col("contract_title").alias("_m_title")), ("prime_contract_key",), ("_m_code", "_m_title")),
        Lookup(lambda: intercompany_list(lg).withColumn("_ic", F.lit(True)), ("project_key",), ("pi_list", "_ic")),
        Lookup(lambda: _cost_structure(lg, "ic_cost_struct_labor_key", "cost_struct_labor", "cost_struct_labor_key")
               .select("ic_cost_struct_labor_key", "ce_code"), ("ic_cost_struct_labor_key",), ("ce_code",)),
        Lookup(fees, ("project_key",), ("fee_method", "fee_factor", "fee_factor_type", "fixed_fee_amount"), many=True),
        Lookup(lambda: F.broadcast(lg.currency_code.select(F.col("currency_code_key").alias("_ooc"),
                                                           F.col("iso_currency_code").alias("owning_org_currency_code"))),
               ("_ooc",), ("owning_org_currency_code",)),
    ]


def _project_outputs(lg, viewer: int) -> dict:
    """Output columns of the project dimension: expression and the columns it is made from."""
    see_bill, see_cost = has_any_role(lg.member, viewer, BILL_BUDGET_ROLES), has_any_role(lg.member, viewer, COST_BUDGET_ROLES)
    plain = lambda name: reads(name)(F.col(name))
    first = lambda a, b: reads(a, b)(F.coalesce(a, b))
    renamed = lambda name: reads(name)(F.col(name))
    return {
        **{c: plain(c) for c in ("project_key", "customer_key")}, "owning_cust_key": renamed("owning_customer_key"),
        **{c: plain(c) for c in (*[f for f, _ in PROJECT_DIM_OPEN_PAIRS], *DOCUMENT_OPEN_FLAGS, "project_code")},
        "project_title": renamed("title"), **{c: plain(c) for c in PROJECT_ATTRIBUTES}, "project_created_date": renamed("created"),
        **{c: reads(c)(mask(F.col(c), see_bill)) for c in PROJECT_BILL_BUDGETS},
        **{c: reads(c)(mask(F.col(c), see_cost)) for c in PROJECT_COST_BUDGETS},
        **{f"{c}_current": first(c, f"orig_{c}") for c in PROJECT_REVISED},
        **{f"{c}_original": renamed(f"orig_{c}") for c in PROJECT_REVISED},
        "funded_value_original": renamed("orig_funded_value"),
        "bill_rate_source": reads("bill_rate_source")(_decode(F.col("bill_rate_source"), BILL_RATE_SOURCES, None)),
        "cost_rate_source": reads("cost_rate_source")(_decode(F.col("cost_rate_source"), COST_RATE_SOURCES, None)),
        **{c: plain(c) for c in ("status", "proj_billing_type_code", "project_type", "cost_structure", "location_name", "pay_code",
                                 "posting_group_name", "customer_type", "project_org_code", "project_org_name", "owning_org_code",
                                 "owning_org_name", "owning_le_code", "owning_le_name")},
        **{f"{who}_{c}": plain(f"{who}_{c}") for who in ("project_manager", "project_lead", "project_viewer") for c in CONTROLLER_COLUMNS},
        **{c: plain(c) for c in ("contract_code", "contract_key", "contract_title")},
        "master_contract_code": first("_m_code", "contract_code"), "master_contract_title": first("_m_title", "contract_title"),
        "total_value_current": first("total_value", "orig_total_value"), "total_value_original": renamed("orig_total_value"),
        "funded_value_current": first("funded_value", "orig_funded_value"),
        "intercompany_effort": reads("_ic")(F.when(F.col("_ic").isNull(), "N").otherwise("Y")),
        "intercompany_support": renamed("pi_list"),
        "default_labor_cost_element": reads("ce_code", "cost_structure")(
            F.when(F.col("ce_code").isNotNull(), concat_nn("cost_structure", F.lit("-"), "ce_code"))),
        "project_fee_method": renamed("fee_method"), "project_fee_factor": renamed("fee_factor"),
        "project_fee_factor_type": renamed("fee_factor_type"),
        **{c: plain(c) for c in ("fixed_fee_amount", "owning_org_currency_code")},
    }


def project_dim(lg, viewer: int, columns=None) -> DataFrame:
    """D54 (+D55-D57, D35): one row per project x primary controllers x first-method fee rows.

    ``columns`` names the output columns wanted; the rows are the same, and
    lookups that neither a wanted column nor the rows need are not planned.
    """
    chosen, needed = pick(_project_outputs(lg, viewer), columns)
    df = filter_project_access(lg, lg.project, "project_key", viewer, PROJECT_DIM_CONTROLLER_ROLES, PROJECT_DIM_OPEN_PAIRS,
                               owner_must_exist=False)
    return join_lookups(df, _project_lookups(lg), needed).select(*chosen)


# ------------------------------------------------------------------ D58
SUMMARY_MAX = ["project_org_code", "project_code", "task_number", "task_name", "transaction_date",
               "billable_amount", "postings_unbilled", "postings_billed", "postings_deferred", "postings_revenue"]
SUMMARY_SUM = ["billable_amount", "postings_unbilled", "postings_billed", "postings_deferred", "postings_revenue"]


def posting_summary(lg, viewer: int, as_of: str, date_from: str, status_like: str = "%Open%",
                    billing_types=("TM", "FP", "CP"), dedupe_dim: bool = False, checkpoint: bool = False, store=None) -> DataFrame:
    """Posting detail joined to the project dimension, grouped by org+project and task labels.

    The dimension has several rows for a project (controllers, fee rows), and a
    SUM counts a posting once for each of them, as the reference does;
    ``dedupe_dim=True`` counts it once.  The detail is summed by project and
    labels first and the sums multiplied by the project's dimension rows, so no
    posting is ever repeated.  ``store`` (a ``PostingStore``) reads the sources
    where they are staged.  ``checkpoint=True`` stores the posting detail in
    the session's checkpoint folder first.
    """
    x = posting_detail(lg, viewer, as_of, store=store)
    if checkpoint:
        from ..session import cut_lineage
        x = cut_lineage(x)
    rows_of = F.lit(1).cast("long") if dedupe_dim else F.count("*")
    dim = (project_dim(lg, viewer, ["project_key", "status", "proj_billing_type_code"])
           .filter(F.col("status").like(status_like) & F.col("proj_billing_type_code").isin(*billing_types))
           .groupBy("project_key").agg(rows_of.alias("_rows")))
    labels = [concat_nn("project_org_code", F.lit(" "), "project_code").alias("_g1"),
              concat_nn("task_number", F.lit(" "), "task_name").alias("_g2")]
    maxes = {f"c{i}": c for i, c in enumerate(SUMMARY_MAX)}
    maxes |= {"c15": "project_key", "c16": "transaction_data_key", "c17": "transaction_type", "c18": "cost_element",
              "c19": "cost_amount"}
    sums = {f"c{i + 10}": c for i, c in enumerate(SUMMARY_SUM)}
    per = (x.filter(F.col("transaction_date") >= F.lit(date_from).cast("timestamp_ntz")).groupBy("project_key", *labels)
           .agg(*[F.max(c).alias(k) for k, c in maxes.items()], *[F.sum(c).alias(k) for k, c in sums.items()]))
    out = per.join(dim, "project_key").groupBy("_g1", "_g2").agg(
        *[F.max(k).alias(k) for k in maxes], *[F.sum(F.col(k) * F.col("_rows")).alias(k) for k in sums])
    return out.orderBy("_g1", "_g2").select(*[f"c{i}" for i in range(20)])
