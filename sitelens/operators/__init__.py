"""Relational operators over crawl facts: cross-page findings, scoring, diffs, history, reports."""
