"""Who may see which rows. A scope that names nothing denies everything."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Forbidden(PermissionError):
    pass


@dataclass(frozen=True)
class Actor:
    is_admin: bool = False
    tenant_id: int | None = None
    user_id: int | None = None


def visible(df: DataFrame, actor: Actor, tenant: str = "tenant_id", user: str = "user_id") -> DataFrame:
    """An administrator sees all rows, another actor its tenant's, one without a tenant its own."""
    if actor.is_admin:
        return df
    return df.where(F.col(tenant) == actor.tenant_id) if actor.tenant_id is not None else df.where(F.col(user) == F.lit(actor.user_id))


def require_tenant(actor: Actor, tenant_id: int) -> int | None:
    """Strict: anyone but an administrator must belong to the tenant."""
    if not actor.is_admin and actor.tenant_id != tenant_id:
        raise Forbidden("not this tenant")
    return tenant_id


def tenant_filter(actor: Actor) -> int | None:
    """Loose: administrators have no filter."""
    return None if actor.is_admin else actor.tenant_id


def chunk_filter(document_ids: list[int] | None = None, section_id: int | None = None, tenant_id: int | None = None) -> Column:
    """Documents (and a section of them), else the tenant; with neither, nothing."""
    if document_ids:
        found = F.col("document_id").isin(list(document_ids))
        return found & (F.col("section_id") == section_id) if section_id is not None else found
    return F.col("tenant_id") == tenant_id if tenant_id is not None else F.lit(False)
