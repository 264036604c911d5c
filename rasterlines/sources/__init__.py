"""DataFrames of images from requests and files."""
