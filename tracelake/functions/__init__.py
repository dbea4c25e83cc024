"""Identity functions shared by the Column path and the Python path."""

from .ids import (
    call_content_id,
    call_history_id,
    canonical,
    content_id,
    content_id_col,
    fresh_id,
    fresh_id_col,
    output_id,
    output_id_col,
    pointer_id,
    pre_call_id,
    list_ids,
    dict_ids,
    set_ids,
    entity_cid,
    entity_hid,
)

__all__ = [
    "call_content_id",
    "call_history_id",
    "canonical",
    "content_id",
    "content_id_col",
    "dict_ids",
    "entity_cid",
    "entity_hid",
    "fresh_id",
    "fresh_id_col",
    "list_ids",
    "output_id",
    "output_id_col",
    "pointer_id",
    "pre_call_id",
    "set_ids",
]
