"""Relational operators: candidates, matching, components, groups, keepers and sessions."""
