"""Vendor invoices: header (D36h), open balance (D36b), aging (D36a), discount date (D36d),
void/recurring links (D36v), AP access filter (D29) and integration reconciliation (D39i).

The document header is a star around ``fin_document`` x ``vendor_invoice``
(both fact-sized, joined on the document key).  Lookups into people, orgs,
terms and currencies are plain equi joins left to Spark's size-based
choice; the post-date -> fiscal-month range lookup is an equi join on a
broadcast calendar-day table.  Activity is aggregated per document before it
is joined (partial aggregation, one narrow shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import MONEY, TOTAL, aging_bucket, fiscal_period
from .access import ADMIN_ROLE
from .intervals import interval_lookup
from .joins import held, left_join_rare, left_join_some, left_join_within, skewed_join

AP_ROLES = (27, 28, 29)
AP_DELEGATE_ROLE = 56


def invoice_balance(activity: DataFrame) -> DataFrame:
    """SUM(invoice - applied - discount) per document, both currencies.

    A NULL part makes that activity line NULL, and SUM skips it.
    """
    def part(c):
        return F.col(c).cast(MONEY)
    return activity.groupBy("fin_document_key").agg(
        F.sum(part("invoice_amount") - part("applied") - part("discount")).alias("balance"),
        F.sum(part("local_invoice_amount") - part("local_applied") - part("local_discount")).alias("local_balance"),
    )


def discount_date(invoice_date, discount_days) -> Column:
    """D36d: invoice date plus the term's discount days (NULL days count as 0)."""
    return F.date_add(F.col(invoice_date), F.coalesce(F.col(discount_days), F.lit(0)).cast("int"))


def ap_grants(viewer: int, member: DataFrame, org_access_person: DataFrame, access_customer_view: DataFrame):
    oap = org_access_person.filter(F.col("person_key") == F.lit(viewer))

    def keys(roles, types):
        o = oap.filter(F.col("role_key").isin(*roles) & F.col("access_type").isin(*types)) \
            .select("org_access_person_key")
        return access_customer_view.join(o, "org_access_person_key").select("customer_key")

    def glob(roles, types) -> Column:
        return oap.filter(F.col("role_key").isin(*roles) & F.col("access_type").isin(*types)
                          & (F.col("global_access") == "Y")).exists()

    admin = member.filter((F.col("person_key") == F.lit(viewer)) & (F.col("role_key") == ADMIN_ROLE)).exists()
    any_ap_global = oap.filter(F.col("role_key").isin(*AP_ROLES) & (F.col("global_access") == "Y")).exists()
    d = AP_DELEGATE_ROLE
    # "both grants": the reference counts rows (COUNT(*) = 2), not distinct access types
    both_global = oap.filter((F.col("role_key") == d) & F.col("access_type").isin(2, 6)
                             & (F.col("global_access") == "Y")).agg(F.count(F.lit(1)).alias("n")) \
        .select("n").scalar() == 2
    return {
        "flag": admin | any_ap_global,
        "le_ap": keys(AP_ROLES, (2, 3)),
        "both_global": both_global,
        "le_56": keys((d,), (2, 3)),
        "vendor_56": keys((d,), (6,)),
        "glob_56_6": glob((d,), (6,)),
        "glob_56_2": glob((d,), (2,)),
    }


def filter_ap_access(df: DataFrame, le_col: str, vendor_col: str, viewer: int, member: DataFrame,
                     org_access_person: DataFrame, access_customer_view: DataFrame) -> DataFrame:
    """Admin, AP roles 27/28/29 (global or by legal entity), or delegate role 56 combinations."""
    g = ap_grants(viewer, member, org_access_person, access_customer_view)
    le, vendor = F.col(le_col), F.col(vendor_col)
    cond = (
        g["flag"]
        | le.isin(g["le_ap"])
        | g["both_global"]
        | (le.isin(g["le_56"]) & g["glob_56_6"])
        | (g["glob_56_2"] & vendor.isin(g["vendor_56"]))
        | (le.isin(g["le_56"]) & vendor.isin(g["vendor_56"]))
    )
    return df.filter(cond)


def _people(lg, role: str) -> DataFrame:
    return lg.person.select(F.col("person_key").alias(f"{role}_key"),
                            F.col("first_name").alias(f"{role}_first_name"),
                            F.col("last_name").alias(f"{role}_last_name"),
                            F.col("username").alias(f"{role}_username"))


def _orgs(lg, role: str) -> DataFrame:
    return lg.customer.select(F.col("customer_key").alias(f"{role}_key"),
                              F.col("customer_code").alias(f"{role}_code"),
                              F.col("customer_name").alias(f"{role}_name"),
                              *([F.col("currency_code_key").alias("_vendor_ccy")] if role == "vendor" else []))


def _doc_numbers(lg, role: str, key: str) -> DataFrame:
    return lg.fin_document.select(F.col("fin_document_key").alias(key),
                                  F.col("document_number").alias(f"_{role}_number"))


def vendor_invoice_header(lg, viewer: int, as_of: str) -> DataFrame:
    """D36h with D36a/b/d/v: one row per vendor invoice the viewer may see.

    A grant depends on the document and its invoice alone, so the filter
    stands before the lookups.  What goes by the document's key is joined
    first, then the lookup tables, which are sent around unless too large.
    """
    near, people = held(lg.customer), held(lg.person)
    fd = lg.fin_document.filter(F.col("fin_document_key").isNotNull())
    vi = lg.vendor_invoice.select(
        "fin_document_key", F.col("account_key").alias("ap_account_key"),
        F.col("organization_key").alias("financial_org_key"), "payment_term_key", "po_key",
        F.col("vendor_org_key").alias("vendor_key"), "discount_amount", "due_date", "hold_reason",
        "invoice_amount", "invoice_date", "local_discount_amount", "local_invoice_amount", "payment_on_hold")
    months = lg.fiscal_month.join(F.broadcast(lg.fiscal_year.select("fiscal_year_key",
                                                                    F.col("name").alias("_fy_name"))),
                                  "fiscal_year_key").select("fiscal_month_key", "period_number", "_fy_name",
                                                            "begin_date", "end_date")
    fdr = lg.fin_document_recurring.select("fin_document_key", F.col("orig_fin_document_key").alias("_orig_key"),
                                           F.col("sequence").alias("occurrence_number"),
                                           F.col("max_occurrences").alias("total_recurrence_number"),
                                           F.lit(True).alias("_recurring"))
    po = lg.purchase_order.filter(F.col("orig_po_key") == F.col("po_key")).select(
        "po_key", F.col("document_number").alias("purchase_order_number"))
    pt = lg.payment_term.select("payment_term_key", F.col("description").alias("payment_terms"), "discount_days")
    remit = (lg.customer_address.filter(F.col("default_remit_to") == "Y")
             .join(lg.address, "address_key")
             .select(F.col("customer_key").alias("vendor_key"), F.col("city").alias("remit_to_address_city"),
                     F.col("country").alias("remit_to_address_country"),
                     F.col("street1").alias("remit_to_address_line1"),
                     F.col("street2").alias("remit_to_address_line2"),
                     F.col("street3").alias("remit_to_address_line3"),
                     F.col("postal_code").alias("remit_to_address_postal_code"),
                     F.col("state_province").alias("remit_to_address_state")))
    acct = lg.account.select(F.col("account_key").alias("ap_account_key"),
                             F.col("account_code").alias("ap_account_code"),
                             F.col("description").alias("ap_account_name"))
    ccy = lg.currency_code
    cc = F.broadcast(ccy.select(F.col("currency_code_key").alias("_vendor_ccy"), F.col("iso_currency_code").alias("_cc")))
    lcc = F.broadcast(ccy.select(F.col("currency_code_key").alias("local_currency"), F.col("iso_currency_code").alias("_lcc")))

    key = "fin_document_key"
    df = filter_ap_access(fd.join(vi, key), "legal_entity_key", "vendor_key", viewer, lg.member, lg.org_access_person,
                          lg.access_customer_view)
    df = df.join(fdr, key, "left").join(invoice_balance(lg.vendor_invoice_activity), key, "left")
    for keys, name, role in ((fdr, "_orig_key", "ofd"), (fd, "voiding_fin_document_key", "voiding"), (fd, "voided_fin_document_key", "voided")):
        df = left_join_rare(df, keys, _doc_numbers(lg, role, name), name, key)
    df = (
        left_join_rare(df, vi, po, "po_key", key)
        .transform(lambda d: interval_lookup(d, "post_date", months, ["fiscal_month_key", "period_number", "_fy_name"]))
        .join(near(_orgs(lg, "legal_entity")), "legal_entity_key")
        .join(pt, "payment_term_key")
        .join(near(_orgs(lg, "vendor")), "vendor_key")
        .join(held(lg.customer_address)(remit), "vendor_key", "left")
        .join(people(_people(lg, "created_by")), F.col("created_by") == F.col("created_by_key"))
        .join(people(_people(lg, "posted_by")), F.col("posted_by") == F.col("posted_by_key"), "left")
        .join(people(_people(lg, "submitted_by")), F.col("submitted_by") == F.col("submitted_by_key"), "left")
        .join(people(_people(lg, "last_modified_by")), F.col("last_updated_by") == F.col("last_modified_by_key"), "left")
        .join(near(_orgs(lg, "financial_org")), "financial_org_key")
        .join(acct, "ap_account_key")
        .join(cc, "_vendor_ccy", "left")
        .join(lcc, "local_currency", "left")
    )
    posted = F.col("posted_timestamp").isNotNull()
    return df.select(
        "fiscal_month_key", F.col("fin_document_key").alias("vendor_invoice_key"),
        F.col("document_number").alias("doc_number"), F.col("reference").alias("vendor_invoice_or_ref"),
        F.col("document_date").alias("doc_date"), "payment_terms", "discount_amount",
        F.col("invoice_date").alias("vendor_invoice_date"), "due_date",
        discount_date("invoice_date", "discount_days").alias("discount_date"),
        F.col("description").alias("doc_description"), F.col("invoice_amount").alias("vendor_invoice_amount"),
        "purchase_order_number", "vendor_key", "vendor_code", "vendor_name", "post_date",
        fiscal_period("_fy_name", "period_number").alias("fiscal_period"),
        F.col("comments").alias("comment"), F.col("status").alias("doc_status"),
        "last_modified_by_first_name", "last_modified_by_last_name", "last_modified_by_username",
        F.col("created_timestamp").alias("created_date"), F.col("last_updated_timestamp").alias("last_modified_date"),
        F.col("submitted_timestamp").alias("submitted_date"), F.col("posted_timestamp").alias("posted_date"),
        "created_by_first_name", "created_by_last_name", "created_by_username",
        "posted_by_first_name", "posted_by_last_name", "posted_by_username",
        "submitted_by_first_name", "submitted_by_last_name", "submitted_by_username",
        "legal_entity_key", "legal_entity_code", "legal_entity_name",
        F.coalesce(F.col("_voiding_number"), F.col("_voided_number")).alias("voiding_or_voided_doc_number"),
        "financial_org_key", "financial_org_code", "financial_org_name",
        "ap_account_key", "ap_account_code", "ap_account_name",
        "remit_to_address_city", "remit_to_address_country", "remit_to_address_line1", "remit_to_address_line2",
        "remit_to_address_line3", "remit_to_address_postal_code", "remit_to_address_state",
        F.when(~posted, F.col("invoice_amount").cast(TOTAL)).otherwise(F.col("balance").cast(TOTAL))
        .alias("current_balance"),
        F.when(F.col("_recurring").isNull(), "No").otherwise("Yes").alias("recurring"),
        F.col("_ofd_number").alias("originating_doc_number"), "occurrence_number", "total_recurrence_number",
        F.col("payment_on_hold").alias("hold_payments"), F.col("hold_reason").alias("hold_payments_reason"),
        "payment_term_key", F.coalesce(F.col("_cc"), F.lit("USD")).alias("currency_code"),
        F.when(posted, F.col("local_discount_amount")).alias("local_discount_amount"),
        F.when(posted, F.col("local_invoice_amount")).alias("local_vendor_invoice_amount"),
        F.coalesce(F.col("_lcc"), F.lit("USD")).alias("local_currency_code"),
        F.when(posted, F.col("local_balance").cast(TOTAL)).alias("local_current_balance"),
        aging_bucket("due_date", as_of).alias("aging"),
        F.date_format("document_date", "MMM yyyy").alias("invoice_month"),
    )


def reconcile_integration(lg, header: DataFrame) -> DataFrame:
    """D39i: integration values FULL OUTER JOIN vendor invoices on internal key = document key.

    No filter on integration name or value type: unrelated integration rows
    stay with NULL document columns, and invoices without one keep NULLs on
    the integration side.
    """
    iv = lg.integration.join(lg.integration_value, "integration_key").select(
        "integration_key", "integration_value_key", "internal_key")
    h = header.select("doc_number", "doc_date", "vendor_code", "vendor_name", "purchase_order_number",
                      "currency_code", "vendor_invoice_date", "post_date", "doc_status", "posted_date",
                      "voiding_or_voided_doc_number", "current_balance", "vendor_invoice_amount",
                      "vendor_invoice_key")
    j = iv.join(h, iv.internal_key == h.vendor_invoice_key, "full_outer")
    return j.select("doc_number", "doc_date", "vendor_code", "vendor_name", "purchase_order_number",
                    "currency_code", "vendor_invoice_date", "post_date", "doc_status", "posted_date",
                    "voiding_or_voided_doc_number", "current_balance", "vendor_invoice_amount",
                    "integration_key", "integration_value_key", "vendor_invoice_key", "internal_key")


# ------------------------------------------------------------------ D37 / D38
# Line-type labels and PO line-id prefixes.
LINE_TYPE_LABELS = {"L": "Labor Details", "E": "Expense Details", "I": "Item Details", "TS": "Matched Labor",
                    "ER": "Matched Expenses", "MIT": "Matched Items", "DFCA": "Funding Cap Adjustment"}
PO_LINE_PREFIXES = [(("L", "TS"), "L"), (("E", "ER"), "E"), (("I", "MIT"), "I")]


def _invoices(lg, key: str, alias: str) -> DataFrame:
    return lg.invoice.select(F.col("invoice_key").alias(key), F.col("invoice_number").alias(alias))


def _line_branch(lg, kind: str, documents: DataFrame | None = None) -> DataFrame:
    """One branch of the line union: labor lines (driven by the project-labor rows) or expense lines."""
    from ..functions.labels import matching_type
    fdd = lg.fin_document_detail
    if documents is not None:
        fdd = fdd.join(documents, "fin_document_key", "left_semi")
    po = lg.fin_document_detail_po
    prj = lg.project.select("project_key", F.col("billing_type_key").alias("_p_bt"))
    t = lg.task.select("task_key", F.col("billing_type_key").alias("_t_bt"))
    cppd = lg.cost_plus_post_detail
    if kind == "labor":
        base = lg.fin_document_det_proj_labor.join(fdd, "fin_document_detail_key")
        det = lg.fin_document_detail_labor.select("fin_document_detail_key", "cost_struct_labor_key",
                                                  F.col("invoice_key").alias("_ia"),
                                                  F.col("manual_invoice_key").alias("_im"))
        descr = lg.po_labor_line_descriptor.select(F.col("po_labor_line_descriptor_key").alias("_descr_key"),
                                                   F.col("line_id").alias("_line_id"),
                                                   F.col("reference").alias("_po_ref"), F.col("po_key").alias("_descr_po"))
        pol = po.select("fin_document_detail_key", F.col("po_key").alias("_dtl_po"),
                        F.col("po_labor_line_descriptor_key").alias("_descr_key"))
        struct = lg.cost_struct_labor.select(F.col("cost_struct_labor_key"), F.col("cost_element_key").alias("_ce"))
        link = cppd.select(F.col("fin_document_det_labor_key").alias("fin_document_detail_key"),
                           F.col("cost_element_key").alias("_ce"), F.col("invoice_key").alias("_icp"))
        lc = lg.labor_category.select("labor_category_key", F.col("account_number").alias("_lc_acct"))
        df = (base.join(det, "fin_document_detail_key", "left").join(pol, "fin_document_detail_key", "left")
              .transform(lambda d: left_join_rare(d, pol, descr, "_descr_key", "fin_document_detail_key"))
              .join(lc, "labor_category_key", "left").join(struct, "cost_struct_labor_key", "left"))
        elem_key = F.col("cost_struct_labor_key")
        qty, rate, lab, exp_type = F.col("hours"), F.col("cost_rate"), F.col("labor_category_key"), F.lit(None)
        acct_number, line_type = F.col("_lc_acct"), "labor"
    else:
        base = fdd.filter(F.col("detail_type") == "E")
        det = lg.fin_document_detail_expense.select("fin_document_detail_key", "cost_struct_odc_key",
                                                    F.col("invoice_key").alias("_ia"),
                                                    F.col("manual_invoice_key").alias("_im"))
        proj = lg.fin_document_det_proj_expense.select("fin_document_detail_key", "expense_type_key", "project_key",
                                                       "task_key", "project_type_key")
        descr = lg.po_expense_line_descriptor.select(F.col("po_expense_line_descriptor_key").alias("_descr_key"),
                                                     F.col("line_id").alias("_line_id"),
                                                     F.col("reference").alias("_po_ref"),
                                                     F.col("po_key").alias("_descr_po"))
        pol = po.select("fin_document_detail_key", F.col("po_key").alias("_dtl_po"),
                        F.col("po_expense_line_descriptor_key").alias("_descr_key"))
        struct = lg.cost_struct_odc.select(F.col("cost_struct_odc_key"), F.col("cost_element_key").alias("_ce"))
        link = cppd.select(F.col("fin_document_det_expense_key").alias("fin_document_detail_key"),
                           F.col("cost_element_key").alias("_ce"), F.col("invoice_key").alias("_icp"))
        df = (base.join(det, "fin_document_detail_key", "left").join(proj, "fin_document_detail_key", "left")
              .join(pol, "fin_document_detail_key", "left")
              .transform(lambda d: left_join_rare(d, pol, descr, "_descr_key", "fin_document_detail_key"))
              .join(struct, "cost_struct_odc_key", "left"))
        elem_key = F.col("cost_struct_odc_key")
        qty, rate, lab, exp_type = F.lit(None), F.lit(None), F.lit(None), F.col("expense_type_key")
        acct_number, line_type = F.lit(None), "expense"
    # a line has at most a few cost elements, so its links are gathered by line
    df = (df.join(prj, "project_key", "left").join(t, "task_key", "left")
          .transform(lambda d: left_join_within(d, link, "fin_document_detail_key", "_ce")))
    for key, number in (("_ia", "_inv_a"), ("_im", "_inv_m"), ("_icp", "_inv_cp")):
        df = left_join_some(df, _invoices(lg, key, number), key, "fin_document_detail_key")
    return df.select(
        F.col("fin_document_detail_key").alias("dtl_fin_document_detail_key"),
        F.col("detail_type").alias("dtl_line_type"), F.col("fin_document_key").alias("dtl_fin_document_key"),
        F.col("account_key").alias("dtl_account_key"), F.col("organization_key").alias("dtl_org_key"),
        elem_key.cast("bigint").alias("dtl_cost_struct_elem_key"), F.col("debit_amount").alias("dtl_debit"),
        F.col("credit_amount").alias("dtl_credit"), F.col("description").alias("dtl_description"),
        F.col("reference").alias("dtl_reference"), exp_type.cast("bigint").alias("dtl_expense_type_key"),
        qty.cast("decimal(18,6)").alias("dtl_qty"), lab.cast("bigint").alias("dtl_labor_category_key"),
        rate.cast("decimal(18,6)").alias("dtl_cost_rate"), F.col("person_key").alias("dtl_person_key"),
        F.col("project_key").alias("dtl_project_key"), F.col("task_key").alias("dtl_task_key"),
        F.col("project_type_key").alias("dtl_project_type_key"),
        F.col("transaction_date").alias("dtl_transaction_date"), F.col("_dtl_po").alias("dtl_po_key"),
        F.col("_descr_key").alias("dtl_po_line_key"), F.col("_line_id").alias("dtl_po_line_id"),
        acct_number.cast("string").alias("account_number"), F.col("_po_ref").alias("reference"),
        F.col("_descr_po").cast("int").alias("po_key"), F.lit(line_type).alias("line_type"),
        matching_type("_t_bt", "_p_bt").alias("matching_type"),
        F.coalesce(F.col("_inv_cp"), F.col("_inv_a"), F.col("_inv_m")).alias("customer_invoice_number"),
    )


def vendor_invoice_lines(lg, documents: DataFrame | None = None) -> DataFrame:
    """D37 (+D37p, D37m, D37c): labor and expense lines of financial documents with their lookups.

    The reference's outer projection names lookups whose joins are missing
    from its text; they are rebuilt here by key [inferred]: document,
    vendor org of the document's vendor invoice, fiscal month of the
    document's post date, account, org, project (+ its org), task, project
    type, labor category, expense type, person, and the cost element through
    the line's labor or ODC cost structure.  ``documents`` (fin_document_key)
    leaves only lines of those documents, before any lookup.
    """
    from ..functions.labels import zero_pad_right
    vi = _line_branch(lg, "labor", documents).unionByName(_line_branch(lg, "expense", documents))
    cust, near = lg.customer, held(lg.customer)
    fd = lg.fin_document.select(F.col("fin_document_key").alias("dtl_fin_document_key"),
                                F.col("document_number").alias("doc_number"), F.col("status").alias("doc_status"),
                                "post_date")
    vorg = (lg.vendor_invoice.select(F.col("fin_document_key").alias("dtl_fin_document_key"), "vendor_org_key")
            .join(near(cust.select(F.col("customer_key").alias("vendor_org_key"), F.col("customer_code").alias("vendor_org_code"),
                                   F.col("customer_name").alias("vendor_org_name"))), "vendor_org_key"))
    months = lg.fiscal_month.join(F.broadcast(lg.fiscal_year.select("fiscal_year_key", F.col("name").alias("_fy"))),
                                  "fiscal_year_key").select("fiscal_month_key", "period_number", "_fy", "begin_date",
                                                            "end_date")
    a = lg.account.select(F.col("account_key").alias("dtl_account_key"), F.col("account_code").alias("details_account_code"),
                          F.col("description").alias("details_account_description"))
    c = cust.select(F.col("customer_key").alias("dtl_org_key"), F.col("customer_code").alias("details_org_code"),
                    F.col("customer_name").alias("details_org_name"))
    p = lg.project.select(F.col("project_key").alias("dtl_project_key"), F.col("project_code").alias("details_project_code"),
                          F.col("title").alias("details_project_title"), F.col("customer_key").alias("_porg"))
    porg = cust.select(F.col("customer_key").alias("_porg"), F.col("customer_code").alias("details_project_org_code"),
                       F.col("customer_name").alias("details_project_org_name"))
    t = lg.task.select(F.col("task_key").alias("dtl_task_key"), F.col("task_number").alias("details_task_number"),
                       F.col("task_name").alias("details_task_name"))
    pt = lg.project_type.select(F.col("project_type_key").alias("dtl_project_type_key"),
                                F.col("project_type").alias("details_project_type"))
    lc = lg.labor_category.select(F.col("labor_category_key").alias("dtl_labor_category_key"), "labor_category")
    et = lg.expense_type.select(F.col("expense_type_key").alias("dtl_expense_type_key"), "expense_type_name")
    per = lg.person.select(F.col("person_key").alias("dtl_person_key"), "last_name", "first_name", "middle_initial",
                           "suffix", "username", "person_code")
    ce_lab = lg.cost_struct_labor.select(F.col("cost_struct_labor_key").alias("_ce_key"), "cost_element_key") \
        .withColumn("_kind", F.lit("labor"))
    ce_odc = lg.cost_struct_odc.select(F.col("cost_struct_odc_key").alias("_ce_key"), "cost_element_key") \
        .withColumn("_kind", F.lit("expense"))
    ce = ce_lab.unionByName(ce_odc).join(lg.cost_element.select("cost_element_key", F.col("code").alias("details_cost_element")),
                                         "cost_element_key", "left").drop("cost_element_key")
    df = (vi.join(fd, "dtl_fin_document_key", "left").join(vorg, "dtl_fin_document_key", "left")
          .transform(lambda d: interval_lookup(d, "post_date", months, ["fiscal_month_key", "period_number", "_fy"], "left"))
          .join(a, "dtl_account_key", "left").join(near(c), "dtl_org_key", "left")
          .join(held(lg.project)(p.join(porg, "_porg", "left")), "dtl_project_key", "left").join(t, "dtl_task_key", "left").join(pt, "dtl_project_type_key", "left")
          .join(lc, "dtl_labor_category_key", "left").join(et, "dtl_expense_type_key", "left")
          .join(held(lg.person)(per), "dtl_person_key", "left")
          .join(ce, (F.col("dtl_cost_struct_elem_key") == F.col("_ce_key")) & (F.col("line_type") == F.col("_kind")),
                "left"))
    lt = F.col("dtl_line_type")
    has_po = F.col("dtl_po_key").isNotNull()
    po_line = None
    for types, prefix in PO_LINE_PREFIXES:
        cond = lt.isin(*types) & has_po
        val = F.concat_ws("", F.lit(prefix), F.col("dtl_po_line_id").cast("string"))
        po_line = F.when(cond, val) if po_line is None else po_line.when(cond, val)
    label = None
    for k, v in LINE_TYPE_LABELS.items():
        label = F.when(lt == k, v) if label is None else label.when(lt == k, v)
    category = (F.when(lt.isin("L", "TS"), F.col("labor_category")).when(lt.isin("E", "ER"), F.col("expense_type_name")))
    null_key = F.lit(None).cast("bigint")
    return df.select(
        "dtl_fin_document_detail_key", null_key.alias("dtl_vendor_invoice_key"), null_key.alias("dtl_time_data_key"),
        null_key.alias("dtl_expense_data_allocation_key"), null_key.alias("dtl_vi_funding_cap_adjustment_key"),
        "dtl_fin_document_key", F.col("po_key").alias("dtl_po_key_int"), "fiscal_month_key",
        F.col("dtl_project_key").alias("project_key"), "vendor_org_key",
        F.col("dtl_org_key").alias("financial_org_key"), "vendor_org_code", "vendor_org_name", "doc_number",
        "doc_status", fiscal_period("_fy", "period_number").alias("fiscal_period"),
        (F.col("dtl_debit") - F.col("dtl_credit")).alias("details_amount"),
        zero_pad_right(F.col("dtl_po_key")).alias("related_po"), po_line.alias("related_po_line_id"),
        F.col("dtl_po_line_id").alias("details_po_line_id"), label.alias("details_type"),
        "details_account_code", "details_account_description", "details_org_code", "details_org_name",
        F.col("dtl_reference").alias("details_reference"), F.col("dtl_description").alias("details_description"),
        F.col("dtl_transaction_date").alias("details_date"), F.col("dtl_qty").alias("details_hours_or_quantity"),
        F.col("dtl_cost_rate").alias("details_rate"), "details_project_org_code", "details_project_org_name",
        "details_project_code", "details_project_title", "details_task_number", "details_task_name",
        "details_project_type", category.alias("details_category"),
        F.col("last_name").alias("details_person_last_name"), F.col("first_name").alias("details_person_first_name"),
        F.col("middle_initial").alias("details_person_middle_initial"), F.col("suffix").alias("details_person_suffix"),
        F.col("username").alias("details_person_username"), F.col("person_code").alias("details_person_code"),
        "details_cost_element", F.col("reference").alias("related_po_line_reference"),
        F.col("account_number").alias("details_labor_category_external_code"), "line_type", "matching_type",
        "customer_invoice_number",
    )


def invoice_line_report(lg, viewer: int, as_of: str, date_from: str, date_to: str) -> DataFrame:
    """Invoice lines RIGHT JOIN invoice headers on the document *number*, by document date.

    ``date_to`` is inclusive to the end of that day: the reference's
    ``23:59:59.997`` upper bound becomes the half-open ``[from, to + 1 day)``.

    Only lines whose document has the number of one dated in that range can
    meet a header, so the others go before any lookup; a header's number and
    date are its document's.
    """
    def dated(df, column):
        return df.filter((F.col(column) >= F.lit(date_from).cast("date"))
                         & (F.col(column) < F.date_add(F.lit(date_to).cast("date"), 1)))

    numbers = dated(lg.fin_document, "document_date").select(F.col("document_number").alias("doc_number"))
    named = lg.fin_document.join(numbers.distinct(), F.col("document_number") == F.col("doc_number"), "left_semi")
    # the documents that have a line of either branch: what the joins of the lines add never drops one
    detail = lg.fin_document_detail.select("fin_document_detail_key", "fin_document_key", "detail_type")
    with_line = (detail.filter(F.col("detail_type") == "E").select("fin_document_key").unionByName(
        lg.fin_document_det_proj_labor.select("fin_document_detail_key").join(detail, "fin_document_detail_key").select("fin_document_key")))
    line_numbers = with_line.join(named.select("fin_document_key", F.col("document_number").alias("_line_doc_number")), "fin_document_key")
    lines = vendor_invoice_lines(lg, named.select("fin_document_key")).select(
        F.col("doc_number").alias("_line_doc_number"), "related_po_line_id", "details_task_name",
        "details_person_code", "details_project_org_name", "details_project_code", "details_category",
        "details_project_type", "details_date", "details_rate", "details_hours_or_quantity", "details_amount",
        "details_person_last_name", "details_person_first_name", "dtl_fin_document_detail_key",
        "dtl_vendor_invoice_key", "dtl_time_data_key", "dtl_expense_data_allocation_key",
        "dtl_vi_funding_cap_adjustment_key")
    header = dated(vendor_invoice_header(lg, viewer, as_of), "doc_date")
    # a document number is text typed by hand: one may stand on many invoices and on many lines
    df = skewed_join(lines, header, "_line_doc_number", "doc_number", "right", left_keys=line_numbers, right_keys=numbers)
    return df.select(
        "doc_number", "doc_date", "vendor_code", "vendor_name", "related_po_line_id", "details_task_name",
        "details_person_code", "details_project_org_name", "details_project_code", "details_category",
        "details_project_type", "details_date", "currency_code", "details_rate", "details_hours_or_quantity",
        "details_amount", "last_modified_date", "voiding_or_voided_doc_number", "vendor_invoice_date",
        "purchase_order_number", "details_person_last_name", "details_person_first_name", "doc_status",
        "vendor_invoice_key", "dtl_fin_document_detail_key", "dtl_vendor_invoice_key", "dtl_time_data_key",
        "dtl_expense_data_allocation_key", "dtl_vi_funding_cap_adjustment_key", "_line_doc_number",
    ).toDF(*[f"c{i}" for i in range(30)])
