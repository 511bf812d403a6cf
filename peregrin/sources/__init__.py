"""peregrin.sources"""
