"""Queries of the driver contract, with equivalent SQL."""
