"""Forecasters that are fitted: linear, tree and boosted models, per setting or per series."""
