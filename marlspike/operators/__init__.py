"""Operators behind ``Query``, each a plan over frames and order keys."""
