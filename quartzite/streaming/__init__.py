"""Bars and states of event streams, equal to their batch counterparts."""
