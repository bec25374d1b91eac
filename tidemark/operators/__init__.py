"""Operators over points, memberships, banks and result tables."""
