"""Predefined procurement models: supplier, order header, order line, AP invoice and order summary.

Each is a single-table model over a staging table or the curated summary. An attribute has its column's name unless
RENAMED says otherwise for its table.
"""

from __future__ import annotations

from kestrel.plans.model import ModelSpec, attr

# Per template its table, its attributes in order with the key first, and the renamed ones.
TEMPLATES_FIXED = {
    "supplier": ("po_supplier", "supplier_code supplier_name tax_code supplier_type country city status"),
    "purchase_order_header": ("po_header", "po_no supplier_code buyer_name company_code branch_plant order_date currency po_status total_amount"),
    "purchase_order_line": ("po_line", "po_line_id po_no line_no item_code item_description uom quantity_ordered quantity_received unit_cost "
                                       "line_amount line_status promised_date"),
    "ap_invoice": ("po_invoice", "invoice_no supplier_code po_no invoice_date due_date currency gross_amount open_amount payment_status status"),
    "purchase_order_summary": ("po_summary", "po_no supplier_code supplier_name buyer_name company_code branch_plant order_date currency po_status "
                                             "total_amount line_count total_ordered_quantity total_received_quantity open_line_count invoice_count "
                                             "total_invoice_amount total_open_invoice_amount payment_status_summary source_updated_at"),
}
RENAMED = {"po_invoice": {"status": "invoice_status"}, "po_summary": {"source_updated_at": "updated_at"}}


def model(name: str) -> ModelSpec:
    table, attributes = TEMPLATES_FIXED[name]
    names, source = attributes.split(), RENAMED.get(table, {})
    return ModelSpec(name=name, attributes=tuple(attr(n, table, source.get(n, n), is_pk=n == names[0]) for n in names))


TEMPLATES = {name: model(name) for name in TEMPLATES_FIXED}
