"""Composites: segmentation, redaction, links, rules, terms, schedules, alignment, versions."""
