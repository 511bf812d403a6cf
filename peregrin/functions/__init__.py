"""peregrin.functions"""
