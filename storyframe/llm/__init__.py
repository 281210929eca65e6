"""Operators for preparing training text: filters, mixing, duplicate removal, decontamination, scoring, token counts."""
