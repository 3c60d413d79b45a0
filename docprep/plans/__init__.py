"""Whole jobs put together from operators."""

from docprep.plans.prepare import outline, page_metadata, prepare_documents, with_options

__all__ = ["outline", "page_metadata", "prepare_documents", "with_options"]
