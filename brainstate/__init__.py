"""Spark jobs for brain-wave data: spectra, mental states, episodes, trials, retrieval and chat logs."""
