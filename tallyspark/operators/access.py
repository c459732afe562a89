"""Row-level access filters and column masking (D28, D29, D16 ...).

A grant check has two parts: viewer-wide flags (admin role, global access)
and sets of allowed keys.  Flags become one-row ``exists()`` subqueries that
Spark evaluates once and inlines; key sets become ``isin(subquery)`` which
Spark plans as an existence join (a broadcast hash join when the allowed set
is small, a shuffle join otherwise).  No filter multiplies fact rows, since
existence joins never duplicate their left side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN_ROLE = 1
FINANCE_ROLE = 33


def _viewer_roles(member: DataFrame, viewer: int, roles) -> DataFrame:
    return member.filter((F.col("person_key") == F.lit(viewer)) & F.col("role_key").isin(*roles))


def finance_grants(viewer: int, member: DataFrame, org_access_person: DataFrame,
                   access_customer_view: DataFrame, customer: DataFrame):
    """(flag column, allowed-org-key DataFrame) for the finance org filter.

    Flag: the viewer is an admin (role 1) or has global finance access
    (role 33, global 'Y').  Allowed orgs: orgs granted directly (access type 2,
    ``legal_entity_ind`` 'N') plus every org whose legal entity is granted
    (``legal_entity_ind`` 'Y').
    """
    oap = org_access_person.filter(
        (F.col("person_key") == F.lit(viewer)) & (F.col("role_key") == FINANCE_ROLE))
    admin = _viewer_roles(member, viewer, [ADMIN_ROLE]).exists()
    glob = oap.filter(F.col("global_access") == "Y").exists()
    granted = (
        access_customer_view.join(
            oap.filter(F.col("access_type") == 2).select("org_access_person_key"), "org_access_person_key")
        .select("customer_key", "legal_entity_ind")
    )
    direct = granted.filter(F.col("legal_entity_ind") == "N").select("customer_key")
    le = granted.filter(F.col("legal_entity_ind") == "Y").select("customer_key")
    via_le = customer.filter(F.col("legal_entity_key").isin(le)).select("customer_key")
    return admin | glob, direct.unionByName(via_le)


def filter_finance_access(df: DataFrame, org_col: str, viewer: int, member: DataFrame,
                          org_access_person: DataFrame, access_customer_view: DataFrame,
                          customer: DataFrame) -> DataFrame:
    """Keep rows whose org the viewer may see."""
    flag, allowed = finance_grants(viewer, member, org_access_person, access_customer_view, customer)
    return df.filter(flag | F.col(org_col).isin(allowed))


def mask(col: Column, allowed: Column) -> Column:
    """Column masking (D16): NULL unless ``allowed`` holds."""
    return F.when(allowed, col)


def has_any_role(member: DataFrame, viewer: int, roles) -> Column:
    return _viewer_roles(member, viewer, list(roles)).exists()
