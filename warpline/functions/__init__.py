"""Part of the warpline engine; see the README."""
