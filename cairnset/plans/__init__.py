"""Queries built from the operators, with equivalent SQL where there is one."""
