"""Fitted plans: decisions taken from data once, applied to any table or stream."""
