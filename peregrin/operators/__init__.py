"""peregrin.operators"""
