"""Stages over rasters: Arrow batches through small numpy kernels."""
